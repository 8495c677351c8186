"""The queries of the llm operators (p4, p8, p9, p10), and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.text import norm_id, trim_all, words
from tessera.llm.bpe import count_tokens, decode_column, encode_column
from tessera.llm.near_dup import similar_groups
from tessera.llm.packing import pack
from tessera.llm.residue import aligned_units, flag_residue, induced_slots
from tessera.session import Written
from tessera.sources.tables import table

#: Tokens in a training sequence.
CAPACITY = 2048
#: Similarity from which atoms are linked, and words their description needs.
THRESHOLD, MIN_WORDS = 0.75, 8


def _atom_groups(spark: SparkSession, d: str) -> DataFrame:
    atoms = table(spark, d, "atoms").select(norm_id(F.col("atom_id")).alias("atom_id"), F.struct("loaded_at", trim_all(F.col("fqdn")).alias("fqdn"), "description").alias("r"))
    last = atoms.where(F.col("atom_id").isNotNull()).groupBy("atom_id").agg(F.max("r").alias("r"))
    told = last.where(F.size(words(F.col("r.description"))) >= MIN_WORDS)
    return similar_groups(told.select("atom_id", F.array_union(words(F.col("r.fqdn")), words(F.col("r.description"))).alias("words")), "atom_id", "words", THRESHOLD)


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    g = Written(_atom_groups(spark, d).select("atom_id", "group")).df
    a = g.select("group", F.col("atom_id").alias("atom_id_a"))
    b = g.select("group", F.col("atom_id").alias("atom_id_b"))
    return a.join(b, "group").where("atom_id_a < atom_id_b").select("atom_id_a", "atom_id_b")


def p4_groups(spark: SparkSession, d: str) -> DataFrame:
    """One row per atom: its group, and the copies of its word set."""
    return _atom_groups(spark, d)


def p8_ids(spark: SparkSession, d: str) -> DataFrame:
    return encode_column(table(spark, d, "documents"), ["doc_id"], "text")


def p8_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """Each document's text, encoded and decoded again."""
    return decode_column(p8_ids(spark, d), ["doc_id"], "ids")


def _packed(spark: SparkSession, d: str) -> DataFrame:
    sizes = Written(count_tokens(table(spark, d, "documents"), ["doc_id"], "text")).df
    return pack(sizes, "doc_id", "n_tokens", CAPACITY)


def p9_sequences(spark: SparkSession, d: str) -> DataFrame:
    """Documents assigned to training sequences: doc_id, part, start, size, container, place."""
    return _packed(spark, d).select("doc_id", "part", "start", "size", "container", F.col("place").cast("bigint").alias("place"))


def p9_fill(spark: SparkSession, d: str) -> DataFrame:
    """Containers, tokens and the share of room used."""
    p = _packed(spark, d).where(F.col("container").isNotNull())
    # pieces are first added up per container, so that distinct containers need no further shuffle
    per = p.groupBy("container").agg(F.sum("size").alias("used"))
    return per.agg(F.count(F.lit(1)).alias("containers"), F.sum("used").alias("tokens"), F.max("used").alias("fullest"), (F.sum("used") / (F.count(F.lit(1)) * CAPACITY)).alias("fill"))


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return flag_residue(table(spark, d, "documents"), "doc_id", "text").select("doc_id")


def p10_kinds(spark: SparkSession, d: str) -> DataFrame:
    """Documents with residue by source, kinds and proof (by the corpus, or by a fixed value only)."""
    flagged = flag_residue(table(spark, d, "documents"), "doc_id", "text")
    return table(spark, d, "documents").select("doc_id", "source").join(flagged, "doc_id").groupBy("source", F.array_join("kinds", "+").alias("kinds"), "proof").agg(F.count(F.lit(1)).alias("n"))


def p10_templates(spark: SparkSession, d: str) -> DataFrame:
    """The slots that the alignment induced: the words around them, and how often and how differently they are filled."""
    return induced_slots(aligned_units(table(spark, d, "documents"), "doc_id", "text")).where("several").select("said", "n_places", "differ", F.col("top").cast("bigint").alias("top"))


def p10_kept(spark: SparkSession, d: str) -> DataFrame:
    """The documents without residue."""
    docs = table(spark, d, "documents")
    return docs.join(flag_residue(docs, "doc_id", "text"), "doc_id", "left_anti").select("doc_id", "lang", "source")


QUERIES = {f.__name__: f for f in (p4_found, p4_groups, p8_ids, p8_round_trip, p9_sequences, p9_fill, p10_found, p10_kinds, p10_templates, p10_kept)}

_TRIM = r"regexp_replace({}, '^[\s\x{{a0}}\x{{3000}}]+|[\s\x{{a0}}\x{{3000}}]+$', '', 'g')"
_W = r"regexp_extract_all(lower({}), '[\p{{L}}\p{{N}}]+')"
_PAIRS = f"""WITH RECURSIVE r AS (SELECT lower({_TRIM.format('atom_id')}) AS id, max(struct_pack(l := loaded_at, f := coalesce({_TRIM.format('fqdn')}, ''), d := coalesce(description, ''))) AS r FROM atoms WHERE {_TRIM.format('atom_id')} <> '' GROUP BY 1),
 w AS (SELECT id, list_distinct(list_concat({_W.format('r.f')}, {_W.format('r.d')})) AS ws FROM r WHERE len({_W.format('r.d')}) >= {MIN_WORDS}),
 p AS (SELECT a.id AS a, b.id AS b, len(list_intersect(a.ws, b.ws)) AS n, len(a.ws) + len(b.ws) AS m FROM w a JOIN w b ON a.id < b.id AND len(a.ws) >= {THRESHOLD} * len(b.ws) AND len(b.ws) >= {THRESHOLD} * len(a.ws)),
 u AS (SELECT a, b FROM p WHERE n >= {THRESHOLD} * (m - n) UNION ALL SELECT b, a FROM p WHERE n >= {THRESHOLD} * (m - n)),
 t AS (SELECT a, b FROM u UNION SELECT t.a, u.b FROM t JOIN u ON u.a = t.b)"""

SQL = {
    "p4_found": _PAIRS + " SELECT a AS atom_id_a, b AS atom_id_b FROM t WHERE a < b",
    "p4_groups": _PAIRS + """, g AS (SELECT w.id, least(w.id, coalesce(min(t.b), w.id)) AS g, any_value(list_sort(w.ws)) AS ws FROM w LEFT JOIN t ON t.a = w.id GROUP BY 1)
SELECT id AS atom_id, g AS "group", count(*) OVER (PARTITION BY ws) AS n_copies FROM g""",
    "p8_round_trip": "SELECT doc_id, coalesce(text, '') AS text FROM documents",
}
