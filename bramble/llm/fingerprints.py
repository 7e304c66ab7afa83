"""Document fingerprints: Merkle trees over sections, paragraphs and blocks of words. DataFrame functions only.

A text is cut into sections at blank lines, paragraphs at line ends, and blocks of at
most eight words. Every byte of a text lies in one leaf or is a separator that the tree's
shape stands for, so roots are equal exactly where texts are; where they differ, the
nodes that differ locate the edit.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import free_name, materialize, table

#: Blocks: at most eight words (longer ones count once for each 64 characters) with the white space around them.
BLOCK = r"[^\S\n]*(?:\S{1,64}[^\S\n]*){1,8}|[^\S\n]+"
_LEAF = 8
_ROWS_A_RANGE, _MOST_RANGES = 1000, 16_384


def _joined(prefix: str, nodes: Column) -> Column:
    return F.sha2(F.concat(F.lit(prefix), F.array_join(nodes, "")), 256)


def leaves(text: Column) -> Column:
    """Hex digests of the blocks of a text by section and paragraph: array of arrays of arrays."""
    return F.transform(
        F.split(text, "\n\n"),
        lambda section: F.transform(F.split(section, "\n"), lambda par: F.transform(F.regexp_extract_all(par, F.lit(BLOCK), F.lit(0)), lambda block: F.sha2(block, 256))),
    )


def paragraph_nodes(tree: Column) -> Column:
    return F.transform(tree, lambda section: F.transform(section, lambda par: _joined("1", par)))


def section_nodes(tree: Column) -> Column:
    return F.transform(paragraph_nodes(tree), lambda pars: _joined("2", pars))


def root(tree: Column) -> Column:
    return _joined("3", section_nodes(tree))


def short_leaves(tree: Column) -> Column:
    return F.transform(F.flatten(F.flatten(tree)), lambda x: F.substring(x, 1, _LEAF))


def fingerprint(tree: Column) -> Column:
    """The root, then the first hex digits of each leaf in order."""
    return F.concat_ws(":", root(tree), F.array_join(short_leaves(tree), ""))


def likeness(a: Column, b: Column) -> Column:
    """Jaccard similarity of two arrays of short leaves; 1 for two texts without leaves."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(a, b)) / union)


def merkle_trees(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """Add the column merkle: root, section and paragraph nodes, leaves. Null texts count as empty."""
    name = free_name(docs.columns, "merkle")
    tree = leaves(F.coalesce(F.col(text_col), F.lit("")))
    held = docs.withColumn(name, tree)
    t = F.col(name)
    return held.withColumn(name, F.struct(root(t).alias("root"), section_nodes(t).alias("sections"), paragraph_nodes(t).alias("paragraphs"), t.alias("leaves")))


def differing_paragraphs(a: Column, b: Column) -> Column:
    """Numbers, from 0, of the paragraphs of a tree `a` whose nodes aren't those of `b` in the same place; empty if the roots are equal."""
    left, right = F.flatten(a["paragraphs"]), F.flatten(b["paragraphs"])
    places = F.sequence(F.lit(0), F.greatest(F.size(left), F.size(right)) - 1)
    return F.when(a["root"] == b["root"], F.array().cast("array<int>")).otherwise(F.filter(places, lambda i: ~F.get(left, i).eqNullSafe(F.get(right, i))))


def _range_number(value: Column, bounds: list[int]) -> Column:
    """How many bounds lie below a value; looked up in two steps of about the root of their number."""
    step = max(1, int(len(bounds) ** 0.5))
    groups = [bounds[i : i + step] for i in range(0, len(bounds), step)]
    tops = F.array(*[F.lit(g[-1]) for g in groups])
    rows = F.array(*[F.array(*[F.lit(x) for x in g + [g[-1]] * (step - len(g))]) for g in groups])
    at = F.least(F.size(F.filter(tops, lambda b: b < value)), F.lit(len(groups) - 1))
    return at * step + F.size(F.filter(F.get(rows, at), lambda b: b < value))


def with_next(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Id, text and the text of the next document by descending id (after the last one: the first).

    One shuffle: rows are dealt by ranges of ids; the first document of each range is sent
    to the range before it too. Repeated ids are ordered by text; a null id comes last, a null text is empty.
    Ids that aren't whole numbers are numbered in their order first, which takes a shuffle more.
    """
    base = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    if isinstance(docs.schema[id_col].dataType, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        base = base.withColumn("key", F.coalesce(F.col("id").cast("long"), F.lit(-(1 << 63))))
    else:
        order = [F.col("id").asc_nulls_first(), F.col("text")]
        base = materialize(base.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("key", F.monotonically_increasing_id()), "numbered")
    n = base.count()
    k = max(1, min(_MOST_RANGES, n // _ROWS_A_RANGE))
    found = base.agg(F.percentile_approx("key", [(i + 1) / k for i in range(k)], 10 * k), F.max("key")).first()
    bounds = sorted({*(found[0] or []), found[1]} - {None}) or [0]
    where = _range_number(F.col("key"), bounds)
    last = F.get(F.array(*[F.lit(b) for b in bounds]), F.col("part")) if len(bounds) <= 64 else None
    edge = F.col("key") == last if last is not None else F.col("key").isin(bounds)
    held = base.withColumn("part", where)
    copies = F.when(edge, F.array(F.struct(F.col("part").alias("p"), F.lit(0).alias("ghost")), F.struct(F.pmod(F.col("part") + 1, F.lit(len(bounds))).alias("p"), F.lit(1).alias("ghost")))).otherwise(F.array(F.struct(F.col("part").alias("p"), F.lit(0).alias("ghost"))))
    dealt = held.select("id", "text", "key", F.explode(copies).alias("c")).select("id", "text", "key", "c.p", "c.ghost")
    order = Window.partitionBy("p").orderBy("ghost", F.desc("key"), F.desc("text"))
    return dealt.withColumn("following", F.lead("text").over(order)).where("ghost = 0").select("id", "text", "following")


def edited_fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of each text and of its edit: the last third replaced by the next document's beginning.

    Columns: the id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited,
    near_next. Null and empty texts have one fingerprint and are 1.0 like each other.
    """
    n = F.char_length("text")
    pairs = with_next(docs, id_col, text_col).select("id", "text", "following", n.cast("long").alias("n_chars"), F.floor(n / 3).cast("int").alias("k"))
    edited = F.concat(F.expr("substring(text, 1, cast(n_chars as int) - k)"), F.expr("substring(following, 1, k)"))
    texts = pairs.select("id", "n_chars", "text", "following", edited.alias("edited"))
    trees = texts.select("id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), leaves(F.col("text")).alias("own"), leaves(F.col("edited")).alias("other"), short_leaves(leaves(F.col("following"))).alias("c"))
    out = trees.select("id", "n_chars", "edited_sha256", "c", root(F.col("own")).alias("r"), root(F.col("other")).alias("s"), short_leaves(F.col("own")).alias("a"), short_leaves(F.col("other")).alias("b"))
    return out.select(F.col("id").alias(id_col), "n_chars", "edited_sha256", F.concat_ws(":", "r", F.array_join("a", "")).alias("fingerprint"), F.concat_ws(":", "s", F.array_join("b", "")).alias("edited_fingerprint"), likeness(F.col("a"), F.col("b")).alias("near_edited"), likeness(F.col("a"), F.col("c")).alias("near_next"))


def op9_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of whole documents and their edits; null texts are empty, repeated rows follow each other, an empty table has no rows."""
    return edited_fingerprints(table(spark, sf_dir, "documents"))


_TREE = r"""list_transform(string_split({0}, chr(10) || chr(10)), lambda s: list_transform(string_split(s, chr(10)), lambda p: list_transform(regexp_extract_all(p, '[^\S\n]*(?:\S{{1,64}}[^\S\n]*){{1,8}}|[^\S\n]+'), lambda b: sha256(b))))"""
_ROOT = "sha256('3' || array_to_string(list_transform({0}, lambda s: sha256('2' || array_to_string(list_transform(s, lambda p: sha256('1' || array_to_string(p, ''))), ''))), ''))"
_SHORT = "list_transform(flatten(flatten({0})), lambda x: x[1:8])"
_NEAR = "CASE WHEN len({0}) + len({1}) = 0 THEN 1.0 ELSE CAST(len(list_intersect({0}, {1})) AS DOUBLE) / len(list_distinct(list_concat({0}, {1}))) END"

OP9_SQL = f"""
WITH base AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
nexts AS (
  SELECT doc_id, text, coalesce(lead(text) OVER (ORDER BY doc_id DESC), first_value(text) OVER (ORDER BY doc_id DESC)) AS following,
         length(text) AS n, length(text) // 3 AS k FROM base),
edits AS (SELECT doc_id, n, text, following, substring(text, 1, n - k) || substring(following, 1, k) AS edited FROM nexts),
trees AS (SELECT doc_id, n, sha256(edited) AS h, {_TREE.format("text")} AS t, {_TREE.format("edited")} AS e, {_TREE.format("following")} AS f FROM edits),
flat AS (SELECT doc_id, n, h, {_ROOT.format("t")} AS r, {_ROOT.format("e")} AS s, {_SHORT.format("t")} AS a, {_SHORT.format("e")} AS b, {_SHORT.format("f")} AS c FROM trees)
SELECT doc_id, CAST(n AS BIGINT) AS n_chars, h AS edited_sha256, r || ':' || array_to_string(a, '') AS fingerprint, s || ':' || array_to_string(b, '') AS edited_fingerprint,
       {_NEAR.format("a", "b")} AS near_edited, {_NEAR.format("a", "c")} AS near_next
FROM flat
"""
