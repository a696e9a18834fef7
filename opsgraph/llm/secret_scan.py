"""Secret scans with a trigram index, in DataFrame functions only.

Each rule's regular expression is parsed into a Boolean query over trigrams that every match must hold: an OR of ANDs.
Concatenated literals and small classes make runs of characters, alternation and options make alternatives, anything
else is a gap; a run's trigrams are all there in a match. The index has a posting (trigram, row) for each trigram of the
rules' queries that a text holds, found in one pass. A rule's candidates are found by intersecting the postings: per row,
the trigrams met are a mask, and one alternative's trigrams must all be in it. Only candidates are verified with the
expression. A rule without mandatory trigrams, such as a run of hex digits, scans every text.

Offsets are code points, ends exclusive. Null counts as empty. Row identity is (doc_id, text hash), so repeated rows get
the same result each and null ids are kept. Very long texts are a row like others. Extra columns are ignored.
"""

from __future__ import annotations

import re._constants as regex
import re._parser
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from opsgraph.llm.common import lower_ascii, saved

#: kind: (expression, group whose length counts, its least length).
RULES: dict[str, tuple[str, int, int]] = {
    "assign": (r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12),
    "access": (r"AKIA[A-Z0-9]+", 0, 18),
    # A greedy run of 16 or more is the longer runs of `[0-9a-f]+`: a shorter run never holds one.
    "hex": (r"[0-9a-f]{16,}", 0, 16),
    "github": (r"gh[pousr]_[A-Za-z0-9]{36,}", 0, 40),
    "slack": (r"xox[abprs]-[A-Za-z0-9-]{10,}", 0, 15),
    "jwt": (r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]+", 0, 24),
    "private_key": (r"-----BEGIN [A-Z ]*PRIVATE KEY-----", 0, 20),
}
#: Characters of a class that are tried one by one, and alternatives that a part of an expression may have; beyond, it is a gap.
CLASS, ALTERNATIVES = 8, 64
BASE = ("assign", "access", "hex")


#: What a match may look like: runs of characters with gaps between.
Runs = tuple[str, ...]
GAP: set[Runs] = {("", "")}


def _joined(a: set[Runs], b: set[Runs]) -> set[Runs]:
    """Every alternative of a followed by every one of b: the last run of one and the first of the other are one."""
    if len(a) * len(b) > ALTERNATIVES:
        b = GAP
    return {(*x[:-1], x[-1] + y[0], *y[1:]) for x in a for y in b}


def _alternatives(parsed: re._parser.SubPattern) -> set[Runs]:
    """The alternatives of a parsed expression."""
    out: set[Runs] = {("",)}
    for op, value in parsed:
        here = GAP
        if op is regex.LITERAL:
            here = {(chr(value),)}
        elif op is regex.IN and value[0][0] is not regex.NEGATE:
            chars = [chr(c) for o, v in value if o in (regex.LITERAL, regex.RANGE) for c in ([v] if o is regex.LITERAL else range(v[0], min(v[1], v[0] + CLASS) + 1))]
            if len(chars) <= CLASS and all(o in (regex.LITERAL, regex.RANGE) for o, _ in value):
                here = {(c,) for c in chars}
        elif op is regex.SUBPATTERN:
            here = _alternatives(value[-1])
        elif op is regex.BRANCH:
            here = set().union(*map(_alternatives, value[1]))
        elif op in (regex.MAX_REPEAT, regex.MIN_REPEAT):
            least, most, part = value
            once = _alternatives(part)
            if (least, most) == (0, 1):
                here = once | {("",)}
            elif least:  # the first and the last are there, with anything between
                here = once if (least, most) == (1, 1) else _joined(_joined(once, GAP), once)
        elif op is regex.AT:
            here = {("",)}
        out = _joined(out, here if len(here) <= ALTERNATIVES else GAP)
    return out


def trigrams(literal: str) -> set[str]:
    return {literal[i : i + 3] for i in range(len(literal) - 2)}


def trigram_query(pattern: str) -> list[set[str]]:
    """The alternatives of an expression's Boolean query, each a set of lower-case trigrams that a match must all hold; none: scan all.

    An alternative that asks for all that another asks for, and more, adds nothing.
    """
    wanted = {frozenset(t for run in runs for t in trigrams(run.lower())) for runs in _alternatives(re._parser.parse(pattern))}
    least = [set(w) for w in wanted if not any(other < w for other in wanted)]
    return sorted(least, key=sorted) if all(least) else []


def queries(rules: dict = RULES) -> dict[str, list[set[str]]]:
    """Each rule's query."""
    return {kind: trigram_query(rule[0]) for kind, rule in rules.items()}


def postings(texts: DataFrame, needed: list[str]) -> DataFrame:
    """(trigram number, doc_id, h) for each of the needed trigrams in a text (doc_id, h, text)."""
    low = texts.select("doc_id", "h", lower_ascii(F.col("text")).alias("low"))
    present = F.filter(F.array(*[F.when(F.contains("low", F.lit(t)), F.lit(i)) for i, t in enumerate(needed)]), lambda x: x.isNotNull())
    return low.select("doc_id", "h", F.explode(present).alias("trigram"))


def candidates(texts: DataFrame, rules: dict = RULES) -> DataFrame:
    """(doc_id, h, kinds): the rules whose trigram query a row meets, from the stored postings."""
    wanted = {kind: alternatives for kind, alternatives in queries(rules).items() if alternatives}
    needed = sorted({t for alternatives in wanted.values() for a in alternatives for t in a})
    index = saved(postings(texts, needed), "trigrams")
    # Intersecting lists is a sum of bits per row; the bit of a trigram counts once however often it is posted.
    words = (len(needed) + 61) // 62
    bit = lambda i: 1 << (i % 62)
    masks = index.groupBy("doc_id", "h").agg(*[F.expr(f"bit_or(if(trigram div 62 = {w}, shiftleft(1L, trigram % 62), 0L)) as m{w}") for w in range(words)])

    def meets(terms: set[str]) -> Column:
        need = [sum(bit(needed.index(t)) for t in terms if needed.index(t) // 62 == w) for w in range(words)]
        return reduce(Column.__and__, [F.col(f"m{w}").bitwiseAND(F.lit(n).cast("bigint")) == F.lit(n).cast("bigint") for w, n in enumerate(need) if n])

    met = F.array(*[F.when(reduce(Column.__or__, [meets(a) for a in alternatives]), F.lit(kind)) for kind, alternatives in wanted.items()])
    return masks.select("doc_id", "h", F.filter(met, lambda k: k.isNotNull()).alias("kinds")).filter(F.size("kinds") > 0)


def spans(text: Column, kind: str, rules: dict = RULES) -> Column:
    """array<struct<start, kind_no, kind, stop>> of the rule's leftmost matches without overlap that are long enough.

    Splitting at the expression gives the pieces between the matches; lengths added up give the offsets.
    """
    pattern, group, least = rules[kind]
    between = F.split(text, pattern, -1)
    match = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    part = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else match
    rows = F.arrays_zip(F.transform(F.slice(between, F.lit(1), F.size(match)), F.length).alias("gap"), F.transform(match, F.length).alias("size"), F.transform(part, F.length).alias("counted"))
    empty = F.array().cast("array<struct<start:int,kind_no:int,kind:string,stop:int>>")
    number = list(rules).index(kind)
    found = F.aggregate(
        rows,
        F.struct(F.lit(0).alias("at"), empty.alias("out")),
        lambda a, x: F.struct(
            (a["at"] + x["gap"] + x["size"]).alias("at"),
            F.when(x["counted"] >= least, F.concat(a["out"], F.array(F.struct((a["at"] + x["gap"]).alias("start"), F.lit(number).alias("kind_no"), F.lit(kind).alias("kind"), (a["at"] + x["gap"] + x["size"]).alias("stop"))))).otherwise(a["out"]).alias("out"),
        ),
        lambda a: a["out"],
    )
    return F.when(F.rlike(text, F.lit(pattern)), found).otherwise(empty)


def scan(docs: DataFrame, rules: dict = RULES) -> DataFrame:
    """(doc_id, spans): per row all secrets found, ordered by start, then rule."""
    text = F.coalesce(F.col("text"), F.lit(""))
    texts = docs.select("doc_id", text.alias("text")).withColumn("h", F.xxhash64("text"))
    found = candidates(texts, rules)
    c, t = found.alias("c"), texts.alias("t")
    joined = t.join(c, F.col("t.doc_id").eqNullSafe(F.col("c.doc_id")) & (F.col("t.h") == F.col("c.h")), "left").select("t.doc_id", "t.text", "c.kinds")
    none = F.array().cast("array<struct<start:int,kind_no:int,kind:string,stop:int>>")
    each = []
    for kind, wanted in queries(rules).items():
        here = spans(F.col("text"), kind, rules)
        each.append(F.when(F.array_contains("kinds", kind), here).otherwise(none) if wanted else here)
    return joined.select("doc_id", F.array_sort(F.concat(*each)).alias("spans"))


def listed(found: Column) -> Column:
    """Spans as kind:start:end, joined by commas."""
    return F.array_join(F.transform(found, lambda s: F.concat_ws(":", s["kind"], s["start"], s["stop"])), ",")


def report(docs: DataFrame) -> DataFrame:
    """Per document: doc_id, n_assign, n_access, n_hex, base_sha256 (digest of the base rules' list), spans (the list of all)."""
    found = scan(docs)
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("bigint").alias(f"n_{kind}")
    base = F.filter("spans", lambda s: s["kind"].isin(*BASE))
    return found.select("doc_id", *map(count, BASE), F.sha2(listed(base), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"))

