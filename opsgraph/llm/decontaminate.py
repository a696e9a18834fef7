"""Benchmark decontamination with a positional inverted index, in DataFrame functions only.

Documents become token rows once. The index holds, for each indexed term, its postings: row, position and, on request,
the words around the position. A phrase is looked up from its rarest terms: their posting lists, shifted by the term's
offset in the phrase, are intersected on (row, start); what is left is compared word by word with the posting's context.

The index is dealt by document, as the tokens are stored: building it moves no rows, and only postings of terms that
some phrase has among its rarest ones are taken. The rarest places are dealt into blocks of about BLOCK_BYTES, whatever
their number; each block in turn is broadcast and met with the tokens, so more phrases mean more passes over the tokens
by one and the same plan, and no word passes a shuffle but those of postings met.

Null and empty texts have no words. Row identity is an own id, so repeated rows and null or repeated ids stay apart.
Extra columns are ignored.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from opsgraph.llm.common import lower_ascii, saved

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
WINDOW = 13
#: About the most bytes of terms and phrases that are sent to every executor at a time.
BLOCK_BYTES = 32 << 20
#: What a row of a block takes beside its words.
ROW_BYTES = 100


def words(text: Column) -> Column:
    """The words of a text, A-Z in lower case; empty for null."""
    return F.coalesce(F.regexp_extract_all(lower_ascii(text), F.lit(WORD), F.lit(0)), F.array().cast("array<string>"))


def token_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(rid, doc_id, words) of every row, stored. rid is fixed by the stored table."""
    rows = docs.select(F.monotonically_increasing_id().alias("rid"), F.col(id_col).alias("doc_id"), words(F.col(text_col)).alias("words"))
    return saved(rows, "tokens")


def in_blocks(rows: DataFrame, size: Column, most: int | None = None) -> list[DataFrame]:
    """Stored rows, dealt by a hash into parts that hold at most about `most` bytes each by `size`; a larger row is a part of its own or nearly so.

    Sizes are counted: parts are doubled until the largest fits, or until each row could have one.
    """
    most = BLOCK_BYTES if most is None else most
    size = size + ROW_BYTES
    n, total, largest = rows.select(F.count("*"), F.coalesce(F.sum(size), F.lit(0)), F.coalesce(F.max(size), F.lit(0))).first()
    parts, part = max(1, -(-total // most)), F.pmod(F.xxhash64(*rows.columns), F.lit(1))
    while parts > 1:
        part = F.pmod(F.xxhash64(*rows.columns), F.lit(parts))
        if parts >= n or rows.groupBy(part).agg(F.sum(size).alias("s")).agg(F.max("s")).first()[0] <= max(2 * most, largest):
            break
        parts *= 2
    return [rows.filter(part == k) if parts > 1 else rows for k in range(parts)]


def term_counts(tokens: DataFrame, terms: DataFrame) -> DataFrame:
    """(term, n): how often each of the stored `terms` (term) stands in the tokens; partial counts come before the shuffle."""
    blocks = in_blocks(terms, F.octet_length("term"))
    counted = [tokens.select(F.explode("words").alias("term")).join(F.broadcast(block), "term", "left_semi").groupBy("term").agg(F.count("*").alias("n")) for block in blocks]
    return reduce(DataFrame.union, counted)


def build_index(tokens: DataFrame, terms: DataFrame | None = None) -> DataFrame:
    """Postings (term, rid, pos) of all terms, or of the stored `terms` (term)."""
    rows = tokens.select("rid", F.posexplode("words").alias("pos", "term")).select("term", "rid", "pos")
    if terms is None:
        return rows
    return reduce(DataFrame.union, [rows.join(F.broadcast(block), "term", "left_semi") for block in in_blocks(terms, F.octet_length("term"))])


def postings_met(tokens: DataFrame, lead: DataFrame) -> DataFrame:
    """(rid, win, start, rank, n) of the postings of each phrase's rarest terms, shifted by the term's offset; lead as of rarest_terms, of about BLOCK_BYTES.

    Postings of the rarest term are kept where the words around them are the phrase's.
    """
    lead = lead.select("term", "win", "off", "rank", F.size("phrase").alias("n"), F.when(F.col("rank") == 1, F.col("phrase")).alias("phrase"))
    rows = tokens.select("rid", "words", F.posexplode("words").alias("pos", "term")).join(F.broadcast(lead), "term")
    rows = rows.withColumn("start", F.col("pos") - F.col("off")).filter("start >= 0")
    same = F.slice("words", F.col("start") + 1, F.col("n")) == F.col("phrase")
    return rows.filter((F.col("rank") > 1) | same).select("rid", "win", "start", "rank", "n")


def phrase_table(items: DataFrame, size: int = WINDOW, id_col: str = "item_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """The distinct windows of `size` words, (win, phrase), and (win, item_id). An item of fewer words, but not none, is one window."""
    n = F.size("w")
    item = items.select(F.col(id_col).alias("item_id"), words(F.col(text_col)).alias("w")).filter(n > 0)
    at = F.explode(F.sequence(F.lit(1), F.greatest(n - size + 1, F.lit(1))))
    rows = item.select("item_id", "w", at.alias("at")).select("item_id", F.slice("w", F.col("at"), F.lit(size)).alias("phrase"))
    rows = saved(rows.withColumn("win", F.sha2(F.concat_ws(" ", "phrase"), 256)).distinct(), "windows")
    return rows.select("win", "phrase").distinct(), rows.select("win", "item_id").distinct()


def rarest_terms(phrases: DataFrame, counts: DataFrame, leads: int) -> DataFrame:
    """(win, phrase, off, term, rank) of the `leads` rarest places of each phrase all of whose terms occur."""
    places = phrases.select("win", "phrase", F.posexplode("phrase").alias("off", "term")).join(counts, "term", "left")
    order = Window.partitionBy("win").orderBy(F.col("n").asc_nulls_first(), "off")
    ranked = places.withColumn("rank", F.row_number().over(order)).withColumn("least", F.min(F.coalesce("n", F.lit(0))).over(Window.partitionBy("win")))
    return ranked.filter((F.col("rank") <= leads) & (F.col("least") > 0)).select("win", "phrase", "off", "term", "rank")


def phrase_matches(tokens: DataFrame, phrases: DataFrame, leads: int = 2) -> DataFrame:
    """Exact occurrences (rid, win, start, n) of phrases (win, phrase) in the tokens.

    The posting lists of each phrase's rarest terms are intersected; the rarest term's are those whose context is the phrase.
    """
    vocabulary = saved(phrases.select(F.explode("phrase").alias("term")).distinct(), "vocabulary")
    counts = saved(term_counts(tokens, vocabulary), "counts")
    lead = saved(rarest_terms(phrases, counts, leads), "leads")
    size = F.octet_length("term") + F.octet_length("win") + F.when(F.col("rank") == 1, F.octet_length(F.concat_ws("", "phrase"))).otherwise(F.lit(0))
    found = [saved(postings_met(tokens, block), "postings") for block in in_blocks(lead, size)]
    met = reduce(DataFrame.union, found).groupBy("rid", "win", "start").agg(F.count_distinct("rank").alias("met"), F.min("rank").alias("first"), F.first("n").alias("n"))
    return met.filter((F.col("first") == 1) & (F.col("met") == F.least(F.col("n"), F.lit(leads)))).select("rid", "win", "start", "n")


def proximity_matches(tokens: DataFrame, phrases: DataFrame, slop: int = 5) -> DataFrame:
    """(rid, win, pos): places of a phrase's rarest term that have all its other terms, in any order, within size + slop words on either side."""
    places = phrases.select("win", F.size("phrase").alias("n"), F.explode(F.array_distinct("phrase")).alias("term"))
    terms = saved(places.select("term").distinct(), "terms")
    index = saved(build_index(tokens, terms), "postings")
    counts = index.groupBy("term").agg(F.count("*").alias("c"))
    order = Window.partitionBy("win").orderBy(F.col("c").asc_nulls_first(), "term")
    places = saved(places.join(counts, "term", "left").withColumn("rank", F.row_number().over(order)), "places")
    need = places.groupBy("win").agg(F.count("*").alias("need"))
    seed = index.join(places.filter("rank = 1"), "term").select("rid", "win", "n", F.col("pos").alias("at"))
    rest = index.join(places.filter("rank > 1").select("win", "term"), "term").select("rid", "win", "term", "pos")
    near = seed.join(rest, ["rid", "win"], "left").filter("pos is null or abs(pos - at) <= n + {}".format(int(slop)))
    met = near.groupBy("rid", "win", "at").agg((F.count_distinct("term") + 1).alias("met"))
    return met.join(need, "win").filter("met = need").select("rid", "win", F.col("at").alias("pos"))


def contamination(docs: DataFrame, benchmark: DataFrame, size: int = WINDOW, share: int = 20) -> DataFrame:
    """Per document: doc_id, n_words, n_hit, n_items, items_sha256, contaminated (n_hit > 0 and share * n_hit >= n_words).

    A word is hit if it lies in any occurrence of a benchmark window. No benchmark rows: nothing is hit.
    """
    tokens = token_rows(docs)
    phrases, owners = phrase_table(benchmark, size)
    hits = saved(phrase_matches(tokens, phrases), "hits")
    #: Spans of a row in order of start: each adds what lies beyond the furthest end so far.
    spans = F.array_sort(F.collect_set(F.struct("start", (F.col("start") + F.col("n")).alias("stop"))))
    covered = F.aggregate(
        "spans",
        F.struct(F.lit(0).alias("stop"), F.lit(0).cast("bigint").alias("n")),
        lambda a, s: F.struct(F.greatest(a["stop"], s["stop"]).alias("stop"), (a["n"] + F.greatest(F.lit(0), s["stop"] - F.greatest(a["stop"], s["start"]))).alias("n")),
        lambda a: a["n"],
    )
    per_row = hits.groupBy("rid").agg(spans.alias("spans")).select("rid", covered.alias("n_hit"))
    items = hits.select("rid", "win").distinct().join(owners, "win").groupBy("rid").agg(F.array_sort(F.collect_set(F.col("item_id").cast("string"))).alias("items"))
    rows = tokens.select("rid", "doc_id", F.size("words").cast("bigint").alias("n_words"))
    rows = rows.join(per_row, "rid", "left").join(items, "rid", "left")
    n_hit, none = F.coalesce("n_hit", F.lit(0)), F.array().cast("array<string>")
    return rows.select(
        "doc_id",
        "n_words",
        n_hit.alias("n_hit"),
        F.size(F.coalesce("items", none)).cast("bigint").alias("n_items"),
        F.sha2(F.concat_ws(",", F.coalesce("items", none)), 256).alias("items_sha256"),
        ((n_hit > 0) & (F.lit(share) * n_hit >= F.col("n_words"))).alias("contaminated"),
    )


def clean(docs: DataFrame, benchmark: DataFrame, size: int = WINDOW, share: int = 20) -> DataFrame:
    """docs without the contaminated rows; columns as they are. Rows that agree in doc_id and text are judged alike."""
    row = F.xxhash64("doc_id", "text")
    judged = contamination(docs.select(row.alias("doc_id"), "text"), benchmark, size, share)
    gone = judged.filter("contaminated").select(F.col("doc_id").alias("__gone")).distinct()
    return docs.join(gone, row == F.col("__gone"), "left_anti")
