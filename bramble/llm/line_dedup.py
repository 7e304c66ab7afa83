"""Line dedup by a deletion-neighbourhood join. DataFrame functions only.

Lines are sequences of words; a line goes if an earlier line (by document id, then text,
then line number) is the same, or, for lines of some length, is within one edit: a word
replaced, added or left out. A line's neighbourhood is the line and all variants with one
word deleted, as hashed keys:

* Lines that agree after deleting the same place differ in that word alone.
* A line equal to another's variant lacks one of its words.

So in each key's group the earliest line stands for all others, and groups are never
paired out. Only lines that share a half with another line can have a neighbour; the
others emit no variants. Variants are emitted once; those whose key nothing else has go
before anything else is done with them. Matches are verified on the words themselves.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import free_name, materialize, probable, table

#: Shorter lines are too common to count as near copies; exact copies go at any length.
MIN_WORDS = 6
#: Letters of scripts that are written without spaces; two of them are taken for a word.
_UNSPACED = r"[\p{IsHan}\p{IsHiragana}\p{IsKatakana}\p{IsThai}\p{IsLao}\p{IsKhmer}\p{IsMyanmar}]"
_SPACE = " \t\n\x0b\f\r"
_BLOCK = 64


def with_units(lines: DataFrame, min_words: int) -> DataFrame:
    """Of rows with a `line`, those with a word, with `words`, in lower case and one space apart, in place of the line; and
    `units`, what near copies are told by: the words if there are min_words, or else the letters of scripts without
    spaces, one by one, with the words between them, if there are twice as many; or else an empty string.
    """
    own = [c for c in lines.columns if c != "line"]
    held = lines.select(*own, F.btrim(F.lower("line"), F.lit(_SPACE)).alias("line")).where("line <> ''")
    odd = F.lit(False)
    for c in ["  ", *_SPACE[1:]]:
        odd = odd | F.col("line").contains(c)
    held = held.select(*own, F.when(odd, F.regexp_replace("line", r"\s+", " ")).otherwise(F.col("line")).alias("words"))
    letters = F.when((F.octet_length("words") > F.char_length("words")) & (count_words("words") < min_words) & F.col("words").rlike(_UNSPACED), F.regexp_replace(F.btrim(F.regexp_replace("words", f"({_UNSPACED})", " $1 ")), " +", " "))
    held = held.select(*own, "words", letters.alias("letters"))
    return held.select(*own, "words", F.when(count_words("words") >= min_words, F.col("words")).when(count_words("letters") >= 2 * min_words, F.col("letters")).otherwise("").alias("units"))


def count_words(words: str) -> Column:
    """Of a string, not empty, of words one space apart."""
    return F.octet_length(words) - F.octet_length(F.replace(F.col(words), F.lit(" "), F.lit(""))) + 1


def _xor(values: Column) -> Column:
    return F.aggregate(values, F.lit(0).cast("long"), lambda acc, x: acc.bitwiseXOR(x))


def _variants(words: Column) -> Column:
    """Keys of a line's variants: (place deleted, hash), with place 0 for the line itself.

    A hash is the exclusive-or of a hash for each word and place; places behind the deleted
    one move up. Sums before a place are taken over blocks, so a line of n words costs n * 64.
    """
    def deleted(x: Column) -> Column:
        """x: here and moved hashes, both of them combined, sums before each block, and the sum of all moved ones."""
        return F.transform(
            x["moved"],
            lambda m, i: F.struct(
                (i + 1).alias("place"),
                m.bitwiseXOR(x["total"]).bitwiseXOR(F.get(x["before"], F.floor(i / _BLOCK).cast("int"))).bitwiseXOR(_xor(F.slice(x["both"], (F.floor(i / _BLOCK) * _BLOCK + 1).cast("int"), (i % _BLOCK).cast("int")))).alias("key"),
            ),
        )

    def hashes(w: Column) -> Column:
        return F.struct(F.transform(w, lambda v, i: F.xxhash64(v, i)).alias("here"), F.transform(w, lambda v, i: F.xxhash64(v, i - 1)).alias("moved"))

    def blocks(x: Column) -> Column:
        both = F.zip_with(x["here"], x["moved"], lambda c, d: c.bitwiseXOR(d))
        return _let(both, lambda z: F.struct(x["here"].alias("here"), x["moved"].alias("moved"), z.alias("both"), F.transform(F.sequence(F.lit(0), F.floor((F.size(z) - 1) / _BLOCK).cast("int")), lambda k: _xor(F.slice(z, k * _BLOCK + 1, _BLOCK))).alias("sums")))

    def sums(x: Column) -> Column:
        return F.struct(x["moved"].alias("moved"), x["both"].alias("both"), F.transform(x["sums"], lambda _, k: _xor(F.slice(x["sums"], 1, k))).alias("before"), _xor(x["moved"]).alias("total"), _xor(x["here"]).alias("own"))

    def keys(x: Column) -> Column:
        return F.concat(F.array(F.struct(F.lit(0).alias("place"), x["own"].alias("key"))), deleted(x))

    return _let(words, lambda w: _let(hashes(w), lambda x: _let(blocks(x), lambda y: _let(sums(y), keys))))


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """An expression of a value that is evaluated once, however often the body uses it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def within_one_edit(a: Column, b: Column) -> Column:
    """Whether two arrays of words are the same or one word apart."""
    n, m = F.size(a), F.size(b)
    short = F.least(n, m)

    def ends(differs: Column) -> Column:
        same = F.when(differs == 0, short).otherwise(differs - 1)
        rest = F.greatest(short - same - F.when(n == m, 1).otherwise(0), F.lit(0)).cast("int")
        return F.when(rest > 0, F.slice(a, n - rest + 1, rest) == F.slice(b, m - rest + 1, rest)).otherwise(True)

    first = F.array_position(F.zip_with(F.slice(a, 1, short), F.slice(b, 1, short), lambda x, y: x != y), True)
    return (F.abs(n - m) <= 1) & _let(first.cast("int"), ends)


def repeated_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """Per text that loses lines: doc_id, twin (a hash of the text) and `gone`, the numbers of its lines (from 0) that repeat an earlier one.

    Rows of one id and text are one document; different texts of an id are documents that
    follow each other by their hash. Rows without an id neither lose lines nor stand for others.
    """
    texts = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text_col).alias("twin"), F.col(text_col).alias("text")).where("doc_id is not null and text is not null")
    lines = with_units(texts.select("doc_id", "twin", F.posexplode(F.split("text", "\n")).alias("pos", "line")), min_words)
    n = F.col("n")

    def halves(m: Column) -> list[Column]:
        h = F.floor(m / 2).cast("int")
        return [F.xxhash64(F.lit("head"), m, F.call_function("substring_index", F.col("units"), F.lit(" "), h)), F.xxhash64(F.lit("tail"), m, F.call_function("substring_index", F.col("units"), F.lit(" "), h - m))]

    lines = lines.select("doc_id", "twin", "pos", "words", "units", count_words("units").alias("n"))
    keyed = lines.select("doc_id", "twin", "pos", F.xxhash64("words").alias("h1"), F.xxhash64(F.lit("second"), "words").alias("h2"), F.when(F.col("units") != "", F.array(*halves(n), *halves(n - 1))).alias("halves"))
    keyed = materialize(keyed, "lines")
    place = F.struct("doc_id", "twin", "pos")
    first = materialize(keyed.groupBy("h1", "h2").agg(F.min(place).alias("first"), F.min("halves").alias("halves")), "first")
    exact = keyed.select("doc_id", "twin", "pos", "h1", "h2").join(first.select("h1", "h2", "first"), ["h1", "h2"]).where(F.col("first") != place).select("doc_id", "twin", "pos")

    half = first.select("first.*", F.explode("halves").alias("half"))
    shared = F.count("*").over(Window.partitionBy("half")) > 1  # distinct lines alone have keys here
    near = half.withColumn("shared", shared).where("shared").select("doc_id", "twin", "pos").distinct().groupBy("doc_id", "twin").agg(F.collect_list("pos").alias("wanted"))
    near = materialize(near, "wanted")

    picked = _let(F.split("text", "\n"), lambda own: F.transform("wanted", lambda p: F.struct(p.alias("pos"), F.get(own, p).alias("line"))))
    held = probable(texts, near, ["doc_id", "twin"]).join(near, ["doc_id", "twin"]).select("doc_id", "twin", F.explode(picked).alias("l")).select("doc_id", "twin", "l.pos", "l.line")
    held = with_units(held, min_words).where("units <> ''").select(place.alias("at"), F.split("units", " ").alias("words")).dropDuplicates(["at"])
    held = materialize(held, "near")

    variants = held.select("at", F.size("words").alias("n"), F.explode(_variants(F.col("words"))).alias("v")).select("at", F.xxhash64(F.when(F.col("v.place") == 0, F.col("n")).otherwise(F.col("n") - 1), "v.key").alias("key"), "v.place")
    variants = materialize(variants, "variants")
    several = variants.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key")
    variants = materialize(variants.join(several.hint("shuffle_hash"), "key", "left_semi"), "shared")
    groups = variants.groupBy("key", "place").agg(F.min("at").alias("first"), F.max("at").alias("last"))
    both = groups.groupBy("key").agg(F.min(F.when(F.col("place") == 0, F.col("first"))).alias("whole"), F.min(F.when(F.col("place") > 0, F.col("first"))).alias("cut"), F.min("first").alias("low"), F.max("last").alias("high")).where("low <> high").select("key", "whole", "cut")
    # Of each key: the earliest line deleted at the same place, or the whole line; of a whole line: the earliest with a word more.
    of_place = groups.join(both, "key").select("key", "place", F.when(F.col("place") == 0, F.col("cut")).when(F.col("whole").isNull(), F.col("first")).otherwise(F.least("whole", "first")).alias("witness"))
    pairs = variants.join(of_place, ["key", "place"]).where("witness < at").select("at", "witness").distinct()
    a = held.select("at", F.col("words").alias("wa"))
    b = held.select(F.col("at").alias("witness"), F.col("words").alias("wb"))
    close = pairs.join(a, "at").join(b, "witness").where(within_one_edit(F.col("wa"), F.col("wb"))).select("at.*")
    # A distinct line that goes takes its copies along: all but the first are gone already.
    gone = exact.union(close).distinct()
    return gone.groupBy("doc_id", "twin").agg(F.collect_set("pos").alias("gone"))


def drop_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """All columns of `docs`, plus n_lines and n_removed (names that are free), with repeated lines taken out of the text.

    Exact copies of all lines with a word go, near copies of lines of min_words words or
    more. Null texts stay null with 0 lines, empty texts have one empty line; lines without
    a word stay. Repeated rows of an id and text lose the same lines, and count once as
    written; rows without an id stay as they are. An empty table gives an empty table; a
    text may have any number of lines and words.
    """
    total, removed = free_name(docs.columns, "n_lines"), free_name(docs.columns, "n_removed")
    gone, key, twin = (free_name(docs.columns, x) for x in ("gone", "gone_id", "gone_twin"))
    found = repeated_lines(docs, id_col, text_col, min_words).select(F.col("doc_id").alias(key), F.col("twin").alias(twin), F.col("gone").alias(gone))
    out = docs.join(found, (F.col(id_col) == F.col(key)) & (F.xxhash64(text_col) == F.col(twin)), "left")
    kept = _let(F.split(text_col, "\n"), lambda lines: F.array_join(F.transform(F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col(gone)), lambda i: F.get(lines, i)), "\n"))
    return out.select(
        *[F.when(F.col(gone).isNull(), F.col(c)).otherwise(kept).alias(c) if c == text_col else F.col(c) for c in docs.columns],
        F.when(F.col(text_col).isNull(), 0).otherwise(F.octet_length(text_col) - F.octet_length(F.replace(F.col(text_col), F.lit("\n"), F.lit(""))) + 1).cast("long").alias(total),
        F.when(F.col(gone).isNull(), 0).otherwise(F.size(gone)).cast("long").alias(removed),
    )


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole documents without repeated lines; nulls, empty and repeated rows as drop_lines says."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return drop_lines(docs).select("doc_id", "n_lines", "n_removed", F.sha2("text", 256).alias("kept_sha256"))


OP6_SQL = r"""
WITH raw AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS pos FROM documents WHERE text IS NOT NULL),
lines AS (
  SELECT doc_id, pos, list_filter(regexp_split_to_array(lower(line), '\s+'), lambda w: w <> '') AS w,
         list_filter(regexp_split_to_array(regexp_replace(lower(line), '([\p{Han}\p{Hiragana}\p{Katakana}\p{Thai}\p{Lao}\p{Khmer}\p{Myanmar}])', ' \1 ', 'g'), '\s+'), lambda w: w <> '') AS u
  FROM raw),
long AS (SELECT doc_id, pos, w, u, row_number() OVER (PARTITION BY w ORDER BY doc_id, pos) AS nth FROM lines WHERE len(w) > 0),
firsts AS (SELECT doc_id, pos, x AS w, len(x) AS n FROM (SELECT doc_id, pos, CASE WHEN len(w) >= 6 THEN w WHEN len(u) > len(w) AND len(u) >= 12 THEN u END AS x FROM long WHERE nth = 1) WHERE x IS NOT NULL),
halves AS (
  SELECT doc_id, pos, w, n, m, side,
         CASE WHEN side = 0 THEN md5(array_to_string(w[1:m // 2], ' ')) ELSE md5(array_to_string(w[n - (m - m // 2) + 1:n], ' ')) END AS half
  FROM (SELECT *, unnest([n, n - 1]) AS m FROM firsts) CROSS JOIN (VALUES (0), (1)) s(side)),
near AS (
  SELECT DISTINCT b.doc_id, b.pos FROM halves a JOIN halves b ON a.m = b.m AND a.side = b.side AND a.half = b.half AND (a.doc_id, a.pos) < (b.doc_id, b.pos)
  WHERE (a.n = b.n AND len(list_filter(range(1, a.n + 1), lambda i: a.w[i] <> b.w[i])) <= 1)
     OR (a.n = b.n + 1 AND len(list_filter(range(1, a.n + 1), lambda i: a.w[1:i - 1] = b.w[1:i - 1] AND a.w[i + 1:a.n] = b.w[i:b.n])) > 0)
     OR (b.n = a.n + 1 AND len(list_filter(range(1, b.n + 1), lambda i: b.w[1:i - 1] = a.w[1:i - 1] AND b.w[i + 1:b.n] = a.w[i:a.n])) > 0)),
gone AS (SELECT doc_id, pos FROM long WHERE nth > 1 UNION SELECT doc_id, pos FROM near),
per AS (SELECT r.doc_id, count(*) AS n_lines, count(g.pos) AS n_removed, string_agg(CASE WHEN g.pos IS NULL THEN r.line END, chr(10) ORDER BY r.pos) AS kept
        FROM raw r LEFT JOIN gone g ON r.doc_id = g.doc_id AND r.pos = g.pos GROUP BY 1)
SELECT d.doc_id, CAST(coalesce(p.n_lines, 0) AS BIGINT) AS n_lines, CAST(coalesce(p.n_removed, 0) AS BIGINT) AS n_removed,
       CASE WHEN d.text IS NULL THEN NULL ELSE sha256(coalesce(p.kept, '')) END AS kept_sha256
FROM documents d LEFT JOIN per p USING (doc_id)
"""
