"""Full-text search: BM25 over several fields, facets, match ranges."""

from __future__ import annotations

import unicodedata
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from veldspar.shared import new_path

K1, B = 1.2, 0.75
LIMIT = 100
#: Parts that a term's postings are dealt over.
TERM_PARTS = 16
BETWEEN = r"[^\p{L}\p{M}\p{N}]+"
#: Letters with marks and the letters without, one for one, so that positions stay.
MARKED = "àáâãäåçèéêëìíîïñòóôõöùúûüýÿ"
PLAIN = "aaaaaaceeeeiiiinooooouuuuyy"


def tokens(text: Column) -> Column:
    """Lower-cased runs of letters, marks and digits of two characters or more."""
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), BETWEEN), lambda t: F.length(t) >= 2)


def query_tokens(query: str) -> list[str]:
    """As tokens() cuts texts: the same runs of letters, marks and digits."""
    kept = "".join(c if unicodedata.category(c)[0] in "LMN" else " " for c in query.lower())
    return [t for t in kept.split(" ") if len(t) >= 2]


def search_text(df: DataFrame, fields: list[str]) -> DataFrame:
    """df with search_text: the configured fields, or in a row where none of them has a value all of its text fields."""
    shown = lambda names: F.concat_ws("\n", *[df[f"`{n}`"].cast("string") for n in names])
    texts = [f.name for f in df.schema.fields if f.dataType.typeName() == "string" and f.name != "search_text"]
    own = [n for n in fields if n in df.columns]
    has = F.coalesce(*[df[f"`{n}`"].cast("string") for n in own]).isNotNull() if own else F.lit(False)
    return df.select(*[df[f"`{c}`"] for c in df.columns if c != "search_text"], F.when(has, shown(own) if own else F.lit("")).otherwise(shown(texts)).alias("search_text"))


def postings(df: DataFrame, id_col: str, fields: list[str]) -> DataFrame:
    """(field, term, id, tf): the inverted index."""
    long = df.select(F.col(id_col), F.explode(F.array(*[F.struct(F.lit(f).alias("field"), tokens(df[f]).alias("terms")) for f in fields])).alias("x"))
    return long.select(id_col, "x.field", F.explode("x.terms").alias("term")).groupBy("field", "term", id_col).agg(F.count("*").alias("tf"))


def score(df: DataFrame, id_col: str, fields: list[str], query: str, mode: str = "any") -> DataFrame:
    """Rows that match, with their score and a score for each field.

    The statistics (rows, lengths, document frequencies of the query's tokens) are one row from one scan; a second
    scan scores. Neither shuffles rows. Modes: any token; all tokens, each in any field; phrase, the raw query in
    a field of a row that scores.
    """
    words = query_tokens(query)
    if not words:
        return df.limit(0).select(id_col, F.lit(0.0).alias("score"), *[F.lit(0.0).alias(f"score_{f}") for f in fields])
    distinct = list(dict.fromkeys(words))
    counted = df
    for f in fields:
        counted = counted.withColumn(f"__t_{f}", tokens(df[f]))
    lengths = [F.size(f"__t_{f}").alias(f"__len_{f}") for f in fields]
    tf = [F.size(F.filter(f"__t_{f}", _equals(w))).alias(f"__tf_{f}_{k}") for f in fields for k, w in enumerate(distinct)]
    slim = counted.select(*[df[c] for c in df.columns], *lengths, *tf)
    stats = slim.agg(
        F.count("*").alias("__n"),
        *[F.sum(f"__len_{f}").alias(f"__total_{f}") for f in fields],
        *[F.count_if(F.col(f"__tf_{f}_{k}") > 0).alias(f"__df_{f}_{k}") for f in fields for k in range(len(distinct))],
    )
    both = slim.crossJoin(F.broadcast(stats))  # one row
    parts = []
    for f in fields:
        total = F.lit(0.0)
        for w in words:
            k = distinct.index(w)
            have, freq = F.col(f"__tf_{f}_{k}"), F.col(f"__df_{f}_{k}")
            idf = F.log((F.col("__n") - freq + 0.5) / (freq + 0.5) + 1)
            mean = F.col(f"__total_{f}") / F.col("__n")
            total = total + F.when(have > 0, idf * have * (K1 + 1) / (have + K1 * (1 - B + B * F.col(f"__len_{f}") / mean))).otherwise(0.0)
        parts.append(total.alias(f"score_{f}"))
    scored = both.select(*df.columns, *[c for c in slim.columns if c.startswith("__tf_")], *parts)
    scored = scored.withColumn("score", sum((F.col(f"score_{f}") for f in fields), F.lit(0.0))).where("score > 0")
    if mode == "all":
        for k in range(len(distinct)):
            scored = scored.where(" OR ".join(f"`__tf_{f}_{k}` > 0" for f in fields))
    elif mode == "phrase":
        found = F.lit(False)
        for f in fields:
            found = found | F.contains(F.lower(F.coalesce(f, F.lit(""))), F.lit(query.lower()))
        scored = scored.where(found)
    return scored.select(*df.columns, "score", *[f"score_{f}" for f in fields])


def _equals(word: str):
    return lambda t: t == word


@dataclass(frozen=True)
class Index:
    """postings (key, field, term, id, tf, length of the field) in files sorted by key, a hash of the term that sorts
    without comparing texts, so that a query reads the row groups of its own terms; means (field, rows, mean): all rows, and the mean length of the field over them."""

    postings: DataFrame
    means: DataFrame
    fields: tuple[str, ...]


def _counted(terms: Column) -> Column:
    """Of sorted terms an array of (term, tf): where each run of equal ones starts, up to where the next does."""
    n = F.size(terms)
    starts = F.filter(F.sequence(F.lit(0), n - 1), lambda i: (i == 0) | (F.get(terms, i) != F.get(terms, i - 1)))
    runs = lambda at: F.transform(at, lambda i, k: F.struct(F.get(terms, i).alias("term"), (F.coalesce(F.get(at, k + 1), n) - i).cast("bigint").alias("tf")))
    return F.when(n > 0, F.get(F.transform(F.array(starts), runs), F.lit(0)))  # the array of one binds the starts, which each run would work out again


def write_index(df: DataFrame, id_col: str, fields: list[str], path: str | None = None) -> Index:
    """The index of df, kept in `path` or in the shared folder. Ids are unique. Texts are cut once and counted where they
    are, so that only postings move, once; a term's postings are dealt over parts, as very many rows may hold it."""
    path = path or new_path(df.sparkSession, "index-*")
    long = df.select(F.col(id_col).alias("id"), F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.sort_array(tokens(df[f])).alias("terms")) for f in fields])).alias("x"))
    sized = long.select("id", "x.field", F.size("x.terms").alias("length"), "x.terms")
    each = sized.select("id", "field", "length", F.explode(_counted(F.col("terms"))).alias("t")).select(F.xxhash64("t.term").alias("key"), "field", "t.term", "id", "t.tf", "length")
    dealt = each.repartition("key", F.pmod(F.xxhash64("id"), F.lit(TERM_PARTS)))
    dealt.sortWithinPartitions("key").write.parquet(f"{path}/postings")
    rows = df.count()
    written = df.sparkSession.read.parquet(f"{path}/postings")
    written.groupBy("field").agg(F.lit(rows).alias("rows"), (F.sum("tf") / rows).alias("mean")).write.parquet(f"{path}/means")
    return open_index(df.sparkSession, path, fields)


def open_index(spark: SparkSession, path: str, fields: list[str]) -> Index:
    return Index(spark.read.parquet(f"{path}/postings"), spark.read.parquet(f"{path}/means"), tuple(fields))


def score_index(index: Index, query: str, mode: str = "any", docs: DataFrame | None = None, id_col: str = "id") -> DataFrame:
    """(id, score, a score for each field) as score() gives them, from the postings of the query's terms alone. The mode
    phrase reads the texts of `docs` too."""
    words = query_tokens(query)
    distinct = list(dict.fromkeys(words))
    hits = index.postings.where(F.col("key").isin([F.xxhash64(F.lit(w)) for w in distinct]) & F.col("term").isin(distinct))
    frequencies = hits.groupBy("field", "term").agg(F.count("*").alias("df"))  # a row for each field and term of the query
    met = hits.join(F.broadcast(frequencies), ["field", "term"]).join(F.broadcast(index.means), "field")
    times = F.lit(0)
    for w in distinct:
        times = F.when(F.col("term") == w, words.count(w)).otherwise(times)
    idf = F.log((F.col("rows") - F.col("df") + 0.5) / (F.col("df") + 0.5) + 1)
    value = times * idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("length") / F.col("mean")))
    own = [F.sum(F.when(F.col("field") == f, value).otherwise(0.0)).alias(f"score_{f}") for f in index.fields]
    found = met.groupBy("id").agg(*own, F.size(F.collect_set("term")).alias("terms"))
    if mode == "all":
        found = found.where(F.col("terms") == len(distinct))
    elif mode == "phrase":
        if docs is None:
            raise ValueError("the mode phrase needs the documents")
        holds = [F.contains(F.lower(F.coalesce(docs[f], F.lit(""))), F.lit(query.lower())) for f in index.fields]
        found = found.join(docs.where(F.array_contains(F.array(*holds), True)).select(F.col(id_col).alias("id")), "id", "left_semi")
    return found.select("id", sum((F.col(f"score_{f}") for f in index.fields), F.lit(0.0)).alias("score"), *[f"score_{f}" for f in index.fields])


def top(df: DataFrame, id_col: str, limit: int = LIMIT) -> DataFrame:
    return df.orderBy(F.col("score").desc(), F.col(id_col).asc()).limit(limit)


def facets(results: DataFrame, fields: list[str], most: int = 50) -> DataFrame:
    """(field, value, count) over results, of fields with 2 to `most` values and fewer than half as many values as
    rows."""
    long = results.select(F.explode(F.array(*[F.struct(F.lit(f).alias("field"), results[f].cast("string").alias("value")) for f in fields])).alias("x")).select("x.*").where("value is not null")
    counts = long.groupBy("field", "value").agg(F.count("*").alias("count"))
    total = results.agg(F.count("*").alias("total"))
    # a row for each field
    shown = counts.groupBy("field").agg(F.count("*").alias("values")).crossJoin(F.broadcast(total)).where((F.col("values") > 1) & (F.col("values") <= most) & (F.col("values") / F.col("total") < 0.5))
    return counts.join(F.broadcast(shown.select("field")), "field", "left_semi").select("field", "value", "count")


def facet_filter(df: DataFrame, chosen: dict[str, list[str]]) -> DataFrame:
    """Values of one field are alternatives, fields all hold; a field without chosen values doesn't count."""
    for name, values in chosen.items():
        if values:
            df = df.where(df[name].isin(values))
    return df


def folded(text: Column) -> Column:
    return F.translate(F.lower(text), MARKED, PLAIN)


def match_ranges(df: DataFrame, id_col: str, text_col: str, query: str) -> DataFrame:
    """(id, token, start, end) of all non-overlapping hits of each query token, whatever case and marks."""
    out = None
    for token in dict.fromkeys(query_tokens(query)):
        plain = token.translate(str.maketrans(MARKED, PLAIN))
        gaps = F.transform(F.split(folded(df[text_col]), f"\\Q{plain}\\E"), F.length)
        ends = F.aggregate(gaps, F.array().cast("array<int>"), _running(len(plain)))
        starts = F.slice(ends, F.lit(1), F.size(ends) - 1)
        rows = df.select(id_col, F.lit(token).alias("token"), F.explode(starts).alias("start")).withColumn("end", F.col("start") + len(plain))
        out = rows if out is None else out.unionByName(rows)
    return out


def _running(width: int):
    """Appends where the next gap ends to the ends so far, a match between any two."""
    return lambda ends, gap: F.array_append(ends, F.when(F.size(ends) == 0, gap).otherwise(F.get(ends, F.size(ends) - 1) + width + gap))


def merged_ranges(ranges: DataFrame, id_col: str) -> DataFrame:
    """Ranges that overlap or touch become one."""
    by = Window.partitionBy(id_col).orderBy("start", "end")
    before = F.max("end").over(by.rowsBetween(Window.unboundedPreceding, -1))
    opened = ranges.withColumn("opens", F.when(F.coalesce(F.col("start") > before, F.lit(True)), 1).otherwise(0))
    runs = opened.withColumn("run", F.sum("opens").over(by))
    return runs.groupBy(id_col, "run").agg(F.min("start").alias("start"), F.max("end").alias("end")).drop("run")
