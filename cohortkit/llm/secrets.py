"""Secret scans with corpus-wide ownership frequency (DataFrame functions only).

Three base patterns and one generic pattern give candidate spans.  The hash of
each candidate's value is counted over the whole corpus by distinct repositories
and distinct owners (here: documents, and the sources they come from).  A value
held by more than ``max_owners`` owners is a copied example; one that stays with
few owners and looks random is ``live``.  Both verdicts are added as spans over
the value; base spans always stay.

With ``by_content`` (as ``redact`` counts) copies of one document are not separate
holders: exact copies and near copies (texts that share two least hashes of their
word runs, and what they connect) are one repository with one owner, so a secret in a
copied document stays ``live``.  Only texts whose verdict would be ``example`` are compared.

Spans of a text are found by splitting it at the pattern: piece and match lengths,
summed along the text, are the offsets (code points).  Rows are keyed by
(id, text hash), so repeated rows are scanned once and each gets the result; a
hot value is pre-aggregated per owner before its owners are counted, and the join
of the counts back to its spans is left to the engine's skew-join splitting.

Defined cases: NULL text counts as empty; NULL ids and sources are values of
their own; an empty table gives no rows; other columns are untouched.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohortkit.llm.common import WORD, sha256_hex, text_or_empty
from cohortkit.llm.simhash import components
from cohortkit.session import materialize

# ---- fixed values: the patterns of the contract, letters of `assign` in either case ----
ASSIGN = (r"([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]"
          r"|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)")
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
GENERIC = r"[A-Za-z0-9+/_-]{20,}"
# ---- end of fixed values ----
# kind -> (order, pattern, group that holds the value, fewest characters of that group)
KINDS = {
    "assign": (0, ASSIGN, 2, 6),
    "access": (1, ACCESS, 0, 20),
    "hex": (2, "[0-9a-f]{24,}", 0, 24),  # maximal runs, so the same as HEX with short runs dropped
    "generic": (3, GENERIC, 0, 20),
}
BASE = ("assign", "access", "hex")
# a text without any of these has no span
ANY = (r"(?:[Pp][Aa][Ss][Ss][Ww]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])"
       r"[A-Za-z\"']*\x20*[:=]|AKIA[A-Z0-9]{16}|[0-9a-f]{24}|" + GENERIC)


def _matches(keyed: DataFrame, kind: str) -> DataFrame:
    """One row per match of a kind: id, th, kind, start, end, vstart, value."""
    order, pattern, group, least = KINDS[kind]
    whole = F.regexp_extract_all("text", F.lit(pattern), F.lit(0))
    value = F.regexp_extract_all("text", F.lit(pattern), F.lit(group)) if group else whole
    d = keyed.filter(F.col("text").rlike(pattern)).select(
        "id", "th", F.posexplode(F.arrays_zip(F.split("text", pattern, -1).alias("piece"), whole.alias("whole"),
                                              value.alias("value"))).alias("pos", "m"))
    d = d.select("id", "th", "pos", F.length("m.piece").alias("gap"), F.length("m.whole").alias("n"),
                 F.col("m.value").alias("value"))
    w = Window.partitionBy("id", "th").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    d = d.withColumn("end", F.sum(F.col("gap") + F.coalesce(F.col("n"), F.lit(0))).over(w))
    d = d.filter(F.length("value") >= least)  # also drops the piece after the last match
    # the value is the last part of the match
    return d.select("id", "th", F.lit(order).alias("rank"), F.lit(kind).alias("kind"),
                    (F.col("end") - F.col("n")).alias("start"), "end",
                    (F.col("end") - F.length("value")).alias("vstart"), "value")


def looks_random(v: Column) -> Column:
    """Letters and digits mixed, eight different characters at least."""
    return (v.rlike("[0-9]") & v.rlike("[A-Za-z]")
            & (F.size(F.array_distinct(F.split(v, ""))) >= 8))


def with_hits(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", source_col: str = "source") -> DataFrame:
    """id, th, owner, hit, and the text where it may hold a span; written once, so the patterns pass over all texts once."""
    hit = text_or_empty(F.col(text_col)).rlike(ANY)
    d = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("th"), F.col(source_col).alias("owner"),
                    hit.alias("hit"), F.col(text_col).alias("text"))
    return materialize(d.withColumn("text", F.when(F.col("hit"), F.col("text"))), "secret-hits")


def candidate_spans(staged: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(owners of documents that may hold a span, keyed by id and text hash; their matches; their texts)."""
    hit = staged.filter("hit").select("id", "th", "text", "owner")
    # repeated rows (same id, text and owner) are one; a text under two owners keeps both as owners
    once = hit.groupBy("id", "th").agg(F.first("text").alias("text"))
    owners = hit.select("id", "th", "owner").distinct()
    once = materialize(once, "secret-texts")
    found = None
    for kind in KINDS:
        m = _matches(once, kind)
        found = m if found is None else found.unionByName(m)
    found = found.filter((F.col("kind") != "generic") | looks_random(F.col("value")))
    return materialize(owners, "secret-owners"), materialize(found, "secret-spans"), once


def holders(owners: DataFrame, found: DataFrame) -> DataFrame:
    """vh, th, repo, owner: each value's hash with the texts, documents and sources that hold it."""
    key = (F.col("o.id").eqNullSafe(F.col("f.id"))) & (F.col("o.th") == F.col("f.th"))
    return found.alias("f").join(owners.alias("o"), key).select(
        sha256_hex(F.col("f.value")).alias("vh"), F.col("f.th").alias("th"), F.col("f.id").alias("repo"),
        F.col("o.owner").alias("owner"))


def near_copies(texts: DataFrame, width: int = 4, bands: int = 16) -> DataFrame:
    """(th, root) of texts (th, text) that are near copies of another; root is the least hash of their group.

    The hashes of a text's runs of ``width`` words fall into 2 ``bands`` classes; texts whose least hash agrees in
    both classes of a band are linked.  Runs with a word that could be a value are left out, so that an example
    copied into short texts does not link them.
    """
    words = F.regexp_extract_all("text", F.lit(WORD), F.lit(0))
    runs = F.transform(
        F.sequence(F.lit(1), F.size("words") - (width - 1)),
        lambda i: F.slice("words", i, width))
    plain = F.filter(runs, lambda r: ~F.exists(r, lambda w: w.rlike("[0-9]") & w.rlike("[A-Za-z]") & (F.length(w) >= 8)))
    d = texts.select("th", words.alias("words")).filter(F.size("words") >= width)
    h = d.select("th", F.explode(F.transform(plain, lambda r: F.xxhash64(r))).alias("h"))
    h = h.groupBy("th", F.pmod("h", F.lit(2 * bands)).alias("c")).agg(F.min("h").alias("h"))
    band = h.groupBy("th", F.floor(F.col("c") / 2).alias("band")).agg(
        F.count(F.lit(1)).alias("n"), F.sort_array(F.collect_list("h")).alias("key")).filter("n = 2")
    band = materialize(band.select("th", "band", "key"), "secret-bands")
    first = band.groupBy("band", "key").agg(F.min("th").alias("low"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    edges = band.join(first, ["band", "key"]).select(F.col("th").alias("a"), F.col("low").alias("b"))
    return components(edges).select(F.col("node").alias("th"), "root")


def ownership(held: DataFrame) -> DataFrame:
    """value hash -> distinct repositories and owners that hold it."""
    held = held.select("vh", "repo", "owner")
    # distinct (value, owner, repository) first, then per owner, then per value: no hot key at the last step
    per_repo = held.distinct()
    per_owner = per_repo.groupBy("vh", "owner").agg(F.count(F.lit(1)).alias("repos"))
    return per_owner.groupBy("vh").agg(F.sum("repos").alias("n_repos"), F.count(F.lit(1)).alias("n_owners"))


def by_content_only(held: DataFrame, texts: DataFrame) -> DataFrame:
    """``held`` with one row per value and group of copies: the group is the repository, its least owner the owner."""
    held = materialize(held, "secret-holders")
    doubtful = texts.join(held.select("th").distinct(), "th", "left_semi").select("th", "text").dropDuplicates(["th"])
    held = held.join(near_copies(doubtful), "th", "left").withColumn("repo", F.coalesce("root", "th"))
    per_owner = held.groupBy("vh", "repo", "owner").agg(F.count(F.lit(1)).alias("n"))
    return per_owner.groupBy("vh", "repo").agg(F.min("owner").alias("owner"))


def by_text(held: DataFrame) -> DataFrame:
    """``held`` with one row per value and text: the text is the repository, its least owner the owner."""
    return held.groupBy("vh", F.col("th").alias("repo")).agg(F.min("owner").alias("owner"))


def scan(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", source_col: str = "source",
         max_owners: int = 1, max_repos: int = 3, by_content: bool = False, staged: DataFrame | None = None) -> DataFrame:
    """id, th, kind, rank, start, end: base spans, and a ``live`` or ``example`` span over each candidate value.

    ``example``: more than ``max_owners`` owners, or more than ``max_repos`` repositories hold the value.  Exact copies
    are one repository, owned by the least of their sources; with ``by_content`` near copies are one too.
    ``staged``: ``with_hits`` of the documents, if it is there already.
    """
    staged = with_hits(docs, text_col, id_col, source_col) if staged is None else staged
    owners, found, texts = candidate_spans(staged)
    held = holders(owners, found)
    freq = ownership(by_text(held))
    if by_content:
        freq = materialize(freq, "secret-counts")
        many = (F.col("n_owners") > max_owners) | (F.col("n_repos") > max_repos)
        again = ownership(by_content_only(held.join(freq.filter(many), "vh", "left_semi"), texts))
        freq = freq.filter(~many).unionByName(again)
    base = found.filter(F.col("kind") != "generic").select("id", "th", "rank", "kind", "start", "end")
    j = found.filter(looks_random(F.col("value"))).withColumn("vh", sha256_hex(F.col("value"))).join(freq, "vh")
    copied = (F.col("n_owners") > max_owners) | (F.col("n_repos") > max_repos)
    verdict = j.select(
        "id", "th", F.when(copied, F.lit(5)).otherwise(F.lit(4)).alias("rank"),
        F.when(copied, F.lit("example")).otherwise(F.lit("live")).alias("kind"),
        F.col("vstart").alias("start"), "end").distinct()
    return base.unionByName(verdict)


def joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(
        ":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def span_lists(spans: DataFrame) -> DataFrame:
    """Spans of a text in one sorted array: by start, then kind as listed, then end."""
    s = F.struct("start", "rank", "end", "kind")
    return spans.groupBy("id", "th").agg(F.sort_array(F.collect_list(s)).alias("spans"))


def scan_digests(docs: DataFrame, **kw) -> DataFrame:
    """One row per document with the counts and digests of its spans (all documents, also those without)."""
    staged = with_hits(docs)
    lists = span_lists(scan(docs, staged=staged, **kw))
    d = staged.select(F.col("id").alias("doc_id"), "th", "hit")
    j = d.filter("hit").join(lists, d["doc_id"].eqNullSafe(lists["id"]) & (d["th"] == lists["th"]), "left").select(
        "doc_id", F.coalesce("spans", F.array().cast(lists.schema["spans"].dataType)).alias("spans"))
    none = d.filter(~F.col("hit")).select(
        "doc_id", F.array().cast(lists.schema["spans"].dataType).alias("spans"))
    a = j.unionByName(none)

    def count(kind):
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")

    base = F.filter("spans", lambda s: s["rank"] < len(BASE))
    return a.select("doc_id", *[count(k).alias(f"n_{k}") for k in BASE],
                    sha256_hex(joined(base)).alias("base_sha256"), joined(F.col("spans")).alias("spans"),
                    count("live").alias("n_live"), count("example").alias("n_example"))


def redact(docs: DataFrame, mark: str = "[SECRET]", **kw) -> DataFrame:
    """Rows of ``docs`` with the value of every live secret (copies of a document counted once) replaced by ``mark``.

    ``n_chars`` follows.
    """
    live = scan(docs, **{"by_content": True, **kw}).filter("kind = 'live'")
    lists = span_lists(live).select(F.col("id").alias("__id"), F.col("th").alias("__th"), F.col("spans").alias("__s"))
    # spans of one text that overlap (a value inside a longer run) are merged
    merged = F.aggregate(
        "__s", F.array().cast("array<struct<a:bigint,b:bigint>>"),
        lambda acc, s: F.when(
            (F.size(acc) > 0) & (F.element_at(acc, -1)["b"] >= s["start"]),
            F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(F.struct(
                F.element_at(acc, -1)["a"].alias("a"), F.greatest(F.element_at(acc, -1)["b"], s["end"]).alias("b"))))
        ).otherwise(F.concat(acc, F.array(F.struct(s["start"].cast("long").alias("a"), s["end"].cast("long").alias("b"))))))
    lists = lists.select("__id", "__th", merged.alias("__s"))
    hit = text_or_empty(F.col("text")).rlike(ANY)
    marked = docs.filter(hit)
    j = marked.join(lists, marked["doc_id"].eqNullSafe(lists["__id"]) & (F.xxhash64(marked["text"]) == lists["__th"]),
                    "left")
    new = F.expr(
        "array_join(transform(sequence(0, size(__s)), i -> substring(text, int(if(i = 0, 0, try_element_at(__s, i).b)) + 1,"
        " int(if(i = size(__s), length(text), try_element_at(__s, i + 1).a) - if(i = 0, 0, try_element_at(__s, i).b)))),"
        f" '{mark}')")
    j = j.withColumn("__new", F.when(F.col("__s").isNull(), F.col("text")).otherwise(new))
    out = []
    for c in docs.columns:
        if c == "text":
            out.append(F.col("__new").alias("text"))
        elif c == "n_chars":
            out.append(F.when(F.col("__s").isNull(), marked["n_chars"]).otherwise(
                F.length("__new")).cast(docs.schema["n_chars"].dataType).alias("n_chars"))
        else:
            out.append(marked[c])
    return docs.filter(~hit).unionByName(j.select(*out))
