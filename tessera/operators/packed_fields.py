"""Several values packed in one field: split by the dialect of least description length.

A dialect is a set of delimiters, with or without quoting, inside an optional pair of enclosing marks. Each field
is parsed by every dialect that differs on it; a parse costs the code lengths of its values plus the bits that name
its delimiters. A value's code length is the cheaper of spelling it out and of naming it by its share of all values,
counted over the whole data. The field is then split by its cheapest parse.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.text import EDGE
from tessera.session import Written, partitions

#: Single delimiters a field may use. "  " stands for a run of two or more blanks.
DELIMITERS = [",", ";", "|", "\t", "\n", "·", "、", "，", "；", "  "]
#: Marks that enclose a whole field and belong to no value.
ENCLOSURES = [("[", "]"), ("{", "}"), ("(", ")")]

_CHAR_BITS = 6.0  # a character that is spelled out
_ODD_BITS = 14.0  # a spelled-out delimiter or an outer quote, which a right parse would have consumed


def _cls(delims: list[str]) -> str:
    single = "".join("\\" + d if d in "|[]\\^-" else d for d in delims if d != "  ").replace("\t", r"\t").replace("\n", r"\n\r")
    alt = [f"[{single}]"] if single else []
    return "(?:" + "|".join(alt + ([r"\s{2,}"] if "  " in delims else [])) + ")"


def _tokens(inner: Column, delims: list[str], quoted: bool) -> Column:
    """The raw tokens between delimiters; a quote opens at a token's start and closes before a delimiter or the end."""
    if not delims:
        return F.array(inner)
    d = _cls(delims)
    if not quoted:
        return F.split(inner, d)
    dq = r'"(?:[^"\\]|""|\\.)*"'
    sq = r"'(?:[^'\\]|''|\\.|'(?=\w))*'"
    # each match: a delimiter and the token after it; the field gets one delimiter in front for its first token
    pat = rf"(?s){d}\s*((?:{dq}|{sq})(?=\s*(?:{d}|$))|(?:(?!{d}).)*)"
    return F.regexp_extract_all(F.concat(F.lit(delims[0]), inner), F.lit(pat), F.lit(1))


def _unquote(tok: Column) -> Column:
    t = F.regexp_replace(tok, EDGE, "")
    body = F.substring(t, F.lit(2), F.greatest(F.length(t) - 2, F.lit(0)))

    def plain(q: str) -> Column:
        single = F.replace(body, F.lit(q + q), F.lit(q))
        # JSON reads every escape, \uXXXX included; bare quotes are escaped for it first
        as_json = F.get_json_object(
            F.concat(F.lit('{"v":"'), F.regexp_replace(F.replace(single, F.lit("\\'"), F.lit("'")), r'(?<!\\)"', r'\\"'), F.lit('"}')), "$.v"
        )
        return F.when(F.contains(single, F.lit("\\")), F.coalesce(as_json, F.regexp_replace(single, r"\\(.)", "$1"))).otherwise(single)

    v = (
        F.when(t.rlike(r'(?s)^"(?:[^"\\]|""|\\.)*"$'), plain('"'))
        .when(t.rlike(r"(?s)^'(?:[^'\\]|''|\\.|'(?=\w))*'$"), plain("'"))
        .otherwise(t)
    )
    return F.regexp_replace(v, EDGE, "")


def _inner(field: Column) -> Column:
    t = F.regexp_replace(field, EDGE, "")
    out = t
    for a, b in reversed(ENCLOSURES):
        inside = F.substring(t, F.lit(2), F.length(t) - 2)
        # the first mark and the last belong together only if no pair closes and opens between them
        apart = inside.rlike(rf"^[^{re.escape(a)}{re.escape(b)}]*{re.escape(b)}")
        out = F.when(t.startswith(a) & t.endswith(b) & (F.length(t) >= 2) & ~apart, inside).otherwise(out)
    # a table row in bars: outer bars are delimiters with empty values, which are dropped anyway
    return out


def _spelled(v: Column) -> Column:
    odd = F.length(v) - F.length(F.regexp_replace(v, r"[,;|\t\n·、，；]", "")) + F.when(v.rlike(r"""^["']|["']$"""), 2).otherwise(0)
    return F.length(v) * _CHAR_BITS + odd * (_ODD_BITS - _CHAR_BITS) + 4.0


def _parses(fields: DataFrame) -> DataFrame:
    """One row for each field and dialect that differs on it: field, n, dialect, name_bits, vals."""
    inner = _inner(F.col("_field"))
    mixed = len(DELIMITERS)
    plans: list[tuple[str, list[str], bool, float]] = [("whole", [], True, 2.0), ("whole-raw", [], False, 5.0)]
    plans += [(d, [d], True, 3.0) for d in DELIMITERS] + [(d + "-raw", [d], False, 6.0) for d in DELIMITERS]
    plans += [("mixed", DELIMITERS, True, 3.0 + mixed), ("mixed-raw", DELIMITERS, False, 6.0 + mixed)]
    has_quote = F.col("_in").rlike(r"""["']""")
    hits = {d: F.col("_in").rlike(r"\S\s{2,}\S") if d == "  " else F.contains(F.col("_in"), F.lit(d)) for d in DELIMITERS}
    n_hit = sum((h.cast("int") for h in hits.values()), F.lit(0))
    cands = []
    for name, delims, quoted, bits in plans:
        need = F.lit(True) if quoted else has_quote
        if len(delims) == 1:
            need = need & hits[delims[0]]
        elif delims:
            need = need & (F.col("_n_hit") > 1)
        vals = F.filter(F.transform(_tokens(F.col("_in"), delims, quoted), _unquote if quoted else (lambda t: F.regexp_replace(t, EDGE, ""))), lambda v: v != "")
        n_delims = F.lit(0) if not delims else F.length(F.col("_in")) - F.length(F.regexp_replace(F.col("_in"), _cls(delims), ""))
        cands.append(F.when(need, F.struct(F.lit(name).alias("dialect"), (F.lit(bits) + n_delims * (1.0 if len(delims) < 2 else 2.0)).alias("name_bits"), vals.alias("vals"))))
    return (
        fields.withColumn("_in", inner)
        .withColumn("_n_hit", n_hit)
        .select("_field", "n", F.explode(F.filter(F.array(*cands), lambda c: c.isNotNull())).alias("_c"))
        .select("_field", "n", "_c.*")
    )


def choose_dialects(df: DataFrame, field: str) -> DataFrame:
    """The cheapest parse of each distinct field: (_field, dialect, vals).

    Two passes: the parses that are shortest when spelled out give the value counts; the counts give the code
    lengths by which each field's parse is chosen. Equal fields are one row from the start, so a field that a third
    of all rows share costs no more than another.
    """
    fields = df.where(F.col(field).isNotNull()).groupBy(F.col(field).alias("_field")).agg(F.count(F.lit(1)).alias("n"))
    # parsing costs far more than its bytes suggest, so distinct fields are spread over all tasks and parsed once
    fields = fields.repartition(max(partitions(df.sparkSession), df.sparkSession.sparkContext.defaultParallelism), F.xxhash64("_field"))
    parses = Written(_parses(fields).withColumn("_spelled", F.col("name_bits") + F.aggregate("vals", F.lit(0.0), lambda a, v: a + _spelled(v)))).df
    first = parses.groupBy("_field").agg(F.min_by(F.struct("vals", "n"), F.struct("_spelled", "dialect")).alias("_b"))
    counts = first.select(F.explode("_b.vals").alias("_v"), F.col("_b.n").alias("n")).groupBy("_v").agg(F.sum("n").alias("_c"))
    total = counts.agg(F.sum("_c").alias("_total"))  # one row
    code = counts.join(F.broadcast(total)).select("_v", (F.log2(F.col("_total") / F.col("_c")) + _spelled(F.col("_v")) / F.col("_c")).alias("_bits"))
    many = parses.select("_field", "dialect", "name_bits", F.explode_outer("vals").alias("_v"))
    cost = (
        many.join(code, "_v", "left")
        .groupBy("_field", "dialect")
        .agg((F.first("name_bits") + F.sum(F.coalesce(F.least(_spelled(F.col("_v")), F.col("_bits")), F.lit(0.0)))).alias("_cost"))
    )
    best = cost.groupBy("_field").agg(F.min_by("dialect", F.struct("_cost", "dialect")).alias("dialect"))
    return parses.select("_field", "dialect", "vals").join(best, ["_field", "dialect"], "left_semi")


def split_packed(df: DataFrame, keys: list[str], field: str) -> DataFrame:
    """One row per value of `field`: the keys, pos (bigint, from 0 in field order) and value.

    Null, empty and blank fields give no row. Empty values neither count nor take a position; repeated values each
    count. Rows with equal keys and field are one. Columns other than `keys` and `field` are not read, so clashing
    names do no harm. An unclosed quote is an ordinary character.
    """
    rows = df.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.col(field).alias("_field")).where(F.col("_field").isNotNull()).distinct()
    chosen = choose_dialects(rows, "_field")
    return (
        rows.join(chosen, "_field")
        .select(*[F.col(f"_k{i}").alias(k) for i, k in enumerate(keys)], F.posexplode("vals").alias("pos", "value"))
        .withColumn("pos", F.col("pos").cast("bigint"))
    )
