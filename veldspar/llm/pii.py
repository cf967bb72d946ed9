"""PII by DataFrame functions alone: regular expressions propose spans, checksum validators (Luhn, modulo 97)
confirm them, and whole words near a span, on both sides, adjust its score.

Every pattern is possessive or bounded and starts only where a run of its characters starts, so a text of any
length is read in linear time. A match and the gap before it come out of one scan; positions are the running
sums of their lengths, folded in chunks, so that a text with very many matches stays cheap.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import _common as C

CHUNK, CONTEXT_CHARS = 256, 40
#: A span of the method's own kinds needs this score; base spans stay whatever their score.
LEAST_SCORE = 50
SPAN = "struct<start:bigint,rank:int,end:bigint,kind:string,score:double>"


@dataclass(frozen=True)
class Kind:
    name: str
    pattern: str
    applies: str  # a cheap necessary condition
    score: int  # per cent, and what a context word adds
    more: int
    context: str
    base: bool = True


_OCTET = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]?[0-9])"
KINDS = (
    Kind("email", r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", "@", 90, 10, "e-?mails?|mails?|contacts?|write|reach"),
    Kind("ip", r"(?:\G|(?<![0-9]))[0-9]++(?:\.[0-9]++){3}", r"[0-9]\.[0-9]", 60, 20, "ip|ipv4|hosts?|servers?|address|addresses|logins?"),
    Kind("card", r"[0-9](?:[ -]?[0-9])++", r"[0-9](?:[ -]?[0-9]){11}", 80, 20, "cards?|visa|mastercard|credit|debit|pay|paid|payment"),
    Kind("phone", r"\+[0-9][ ().0-9-]+[0-9]", r"\+[0-9]", 60, 30, "phones?|tel|telephone|calls?|mobile|fax|ring"),
    Kind("iban", r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:(?: [A-Z0-9]{4}){2,7}(?: [A-Z0-9]{1,3})?|[A-Z0-9]{11,30})(?![A-Za-z0-9])", r"[A-Z]{2}[0-9]{2} ?[A-Z0-9]{4}", 80, 15, "iban|accounts?|bank|transfers?", base=False),
    Kind("ssn", r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])", r"[0-9]{3}-[0-9]{2}-[0-9]{4}", 30, 50, "ssn|social security|tax id|national id", base=False),
)


def near_words(kind: Kind) -> str:
    """A pattern of the kind's context words, whole ones, in lower-cased text."""
    return f"(^|[^a-z0-9])({kind.context})([^a-z0-9]|$)"


def luhn(digits: Column) -> Column:
    size = F.length(digits)

    def add(total: Column, k: Column) -> Column:
        digit = digits.substr(size - k + 1, F.lit(1)).cast("int")
        twice = 2 * digit
        return total + F.when(k % 2 == 1, digit).when(twice > 9, twice - 9).otherwise(twice)

    return F.aggregate(F.sequence(F.lit(1), size), F.lit(0), add) % 10 == 0


def mod97(code: Column) -> Column:
    """The check of an IBAN without its spaces."""
    moved = F.concat(code.substr(F.lit(5), F.length(code)), code.substr(F.lit(1), F.lit(4)))

    def add(rest: Column, k: Column) -> Column:
        value = F.conv(moved.substr(k, F.lit(1)), 36, 10).cast("int")
        return F.when(value > 9, (rest * 100 + value) % 97).otherwise((rest * 10 + value) % 97)

    return F.aggregate(F.sequence(F.lit(1), F.length(code)), F.lit(0), add) == 1


def _valid(kind: str, match: Column) -> Column:
    digits = F.regexp_replace(match, "[^0-9]", "")
    if kind == "ip":
        return match.rlike(rf"^{_OCTET}(?:\.{_OCTET}){{3}}$")
    if kind == "card":
        return F.when(F.length(digits).between(12, 19), luhn(digits)).otherwise(F.lit(False))
    if kind == "phone":
        return F.length(digits).between(9, 15)
    if kind == "iban":
        code = F.replace(match, F.lit(" "), F.lit(""))
        return F.when(F.length(code).between(15, 34), mod97(code)).otherwise(F.lit(False))
    return F.lit(True)


def _pieces(text: Column, kind: Kind) -> Column:
    """Of each match the gap before it, its size, whether it is valid and the kind's words are near."""
    whole = F.lit(f"(?s)\\G(.*?)({kind.pattern})(?=(.{{0,{CONTEXT_CHARS}}}))")
    gaps, matches, after = (F.regexp_extract_all(text, whole, F.lit(k)) for k in (1, 2, 3))

    def piece(x: Column) -> Column:
        gap, match = x["0"], x["1"]
        near = F.lower(F.right(gap, F.lit(CONTEXT_CHARS))).rlike(near_words(kind)) | F.lower(x["2"]).rlike(near_words(kind))
        return F.struct(F.length(gap).cast("long").alias("gap"), F.length(match).cast("long").alias("size"), near.alias("near"), F.coalesce(_valid(kind.name, match), F.lit(False)).alias("valid"))

    return F.transform(F.arrays_zip(gaps.alias("0"), matches.alias("1"), after.alias("2")), piece)


def _of_kind(kind: str):
    return lambda span: span["kind"] == kind


def _chunks(pieces: Column) -> Column:
    last = F.floor((F.size(pieces) - 1) / CHUNK).cast("int")
    return F.when(F.size(pieces) > 0, F.transform(F.sequence(F.lit(0), last), lambda k: F.slice(pieces, k * CHUNK + 1, F.lit(CHUNK))))


def _place(chunks: Column, offsets: Column, kind: Kind, rank: int) -> Column:
    zero = F.array().cast(f"array<{SPAN}>")

    def one(chunk: Column, offset: Column) -> Column:
        def step(state: Column, piece: Column) -> Column:
            start = state["at"] + piece["gap"]
            score = F.when(piece["near"], F.lit(kind.score + kind.more)).otherwise(F.lit(kind.score))
            span = F.struct(start.alias("start"), F.lit(rank).alias("rank"), (start + piece["size"]).alias("end"), F.lit(kind.name).alias("kind"), (score / 100).alias("score"))
            keep = piece["valid"] if kind.base else piece["valid"] & (score >= LEAST_SCORE)
            return F.struct((start + piece["size"]).alias("at"), F.when(keep, F.array_append(state["out"], span)).otherwise(state["out"]).alias("out"))

        return F.aggregate(chunk, F.struct(offset.alias("at"), zero.alias("out")), step, lambda state: state["out"])

    return F.flatten(F.zip_with(chunks, F.slice(offsets, F.lit(1), F.size(chunks)), one))


def find_pii(df: DataFrame, text_col: str = "text", out_col: str = "pii_spans") -> DataFrame:
    """df with out_col: all spans of personal data, an array of structs (start, rank, end, kind, score) in the
    order of start and kind; positions are code points, ends are exclusive; score is from 0 to 1. Words count as near
    within 40 characters after a match, and before it back to the match of its kind before.

    A null or empty text has no spans; an empty table gives an empty result; texts of any length are read whole.
    Spans of different kinds may overlap; those that start together stand in the order of KINDS. Repeated rows each
    get their spans. An input column named like the output is replaced; other columns stay, however named.
    """
    df = C.without(df, [out_col] if out_col.lower() != text_col.lower() else [])
    own = [c for c in df.columns if c.lower() != out_col.lower()]
    names = [*own, out_col, text_col]
    text_at = C.free_name(names, "text")
    at = {k.name: C.free_name(names, k.name) for k in KINDS}
    ends = {k.name: C.free_name(names, f"{k.name}_at") for k in KINDS}
    text = F.col(text_at)
    made = df.select("*", C.text_or_empty(F.col(f"`{text_col}`")).alias(text_at))
    here = {k.name: F.contains(text, F.lit(k.applies)) if k.applies == "@" else text.rlike(k.applies) for k in KINDS}
    made = made.withColumns({at[k.name]: F.when(here[k.name], _pieces(text, k)) for k in KINDS})
    made = made.withColumns({name: _chunks(F.col(name)) for name in at.values()})
    offsets = {}
    for k in KINDS:
        sizes = F.transform(at[k.name], lambda c: F.aggregate(c, F.lit(0).cast("long"), lambda total, p: total + p["gap"] + p["size"]))
        offsets[ends[k.name]] = F.aggregate(sizes, F.array(F.lit(0).cast("long")), lambda ends, s: F.array_append(ends, F.element_at(ends, -1) + s))
    made = made.withColumns(offsets)
    none = F.array().cast(f"array<{SPAN}>")
    made = made.withColumns({at[k.name]: F.coalesce(_place(F.col(at[k.name]), F.col(ends[k.name]), k, rank), none) for rank, k in enumerate(KINDS)})
    return made.select(*[F.col(f"`{c}`") for c in own], F.array_sort(F.concat(*[F.col(x) for x in at.values()])).alias(out_col))


def joined(spans: Column) -> Column:
    """kind:start:end, by start and kind, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def scored(spans: Column) -> Column:
    """kind:start:end:score in per cent, by start and kind, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"), F.round(s["score"] * 100).cast("int").cast("string"))), ",")


def _openers(spans: Column) -> Column:
    """Structs (start, kind, before) of the spans that no earlier one overlaps; before is where the last one ended."""
    chunks = _chunks(spans)
    tops = F.transform(chunks, lambda c: F.array_max(F.transform(c, lambda s: s["end"])))
    offsets = F.aggregate(tops, F.array(F.lit(0).cast("long")), lambda ends, top: F.array_append(ends, F.greatest(F.element_at(ends, -1), top)))
    zero = F.array().cast("array<struct<start:bigint,kind:string,before:bigint>>")

    def one(chunk: Column, offset: Column) -> Column:
        def step(state: Column, s: Column) -> Column:
            opener = F.struct(s["start"].alias("start"), s["kind"].alias("kind"), state["at"].alias("before"))
            return F.struct(F.greatest(state["at"], s["end"]).alias("at"), F.array_append(state["out"], opener).alias("out"))

        return F.aggregate(chunk, F.struct(offset.alias("at"), zero.alias("out")), step, lambda state: state["out"])

    return F.filter(F.flatten(F.zip_with(chunks, F.slice(offsets, F.lit(1), F.size(chunks)), one)), lambda o: o["start"] >= o["before"])


def redact(df: DataFrame, text_col: str = "text") -> DataFrame:
    """df with every span of personal data in text_col replaced by its kind in brackets; overlapping spans become
    one, named by the first. A null text stays null; a text without spans stays as it is; repeated rows get equal
    texts; other columns stay, however named. Texts are cut by chunks of spans, so that very many spans stay cheap."""
    own = df.columns
    spans_at, opened_at = C.free_name(own, "spans"), C.free_name(own, "opened")
    found = find_pii(df, text_col, spans_at)
    opened = found.withColumn(opened_at, F.when(F.size(spans_at) > 0, _chunks(_openers(F.col(spans_at)))))
    text = F.col(f"`{text_col}`")

    def clean(chunk: Column) -> Column:
        base = F.get(chunk, F.lit(0))["before"]
        body = text.substr((base + 1).cast("int"), (F.element_at(chunk, -1)["start"] - base).cast("int"))
        return F.array_join(F.transform(chunk, lambda s: F.concat(body.substr((s["before"] - base + 1).cast("int"), (s["start"] - s["before"]).cast("int")), F.lit("["), F.upper(s["kind"]), F.lit("]"))), "")

    tail = text.substr((F.array_max(F.transform(spans_at, lambda s: s["end"])) + 1).cast("int"), F.length(text))
    new = F.when(F.col(opened_at).isNull(), text).otherwise(F.concat(F.array_join(F.transform(opened_at, clean), ""), tail))
    return opened.select(*[new.alias(c) if c == text_col else F.col(f"`{c}`") for c in own])


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = find_pii(C.table(spark, sf_dir, "documents").select("doc_id", "text"))
    spans, base = F.col("pii_spans"), [k for k in KINDS if k.base]
    counts = [F.size(F.filter(spans, _of_kind(k.name))).cast("long").alias(f"n_{k.name}") for k in base]
    of_base = F.filter(spans, lambda s: s["rank"] < len(base))
    return docs.select("doc_id", *counts, F.sha2(joined(of_base), 256).alias("base_sha256"), joined(spans).alias("spans"), scored(spans).alias("scores"))


def _sql() -> str:
    of = {
        "email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+", "true"),
        "ip": (r"[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+", "list_max(list_transform(string_split(m, '.'), lambda p: p::HUGEINT)) <= 255"),
        "card": (r"[0-9](?:[ -]?[0-9])+", "length(d) BETWEEN 12 AND 19 AND list_sum(list_transform(range(1, length(d) + 1), lambda k: CASE WHEN k % 2 = 1 THEN d[length(d) - k + 1]::INT ELSE (2 * d[length(d) - k + 1]::INT) - CASE WHEN d[length(d) - k + 1]::INT > 4 THEN 9 ELSE 0 END END)) % 10 = 0"),
        "phone": (r"\+[0-9][ ().0-9-]+[0-9]", "length(d) BETWEEN 9 AND 15"),
        "iban": (r"\b[A-Z]{2}[0-9]{2}(?:(?: [A-Z0-9]{4}){2,7}(?: [A-Z0-9]{1,3})?|[A-Z0-9]{11,30})\b", "length(c) BETWEEN 15 AND 34 AND list_reduce(list_prepend(0, list_transform(string_split(c[5:] || c[:4], ''), lambda x: strpos('0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ', x) - 1)), lambda r, v: CASE WHEN v > 9 THEN (r * 100 + v) % 97 ELSE (r * 10 + v) % 97 END) = 1"),
        "ssn": (r"\b[0-9]{3}-[0-9]{2}-[0-9]{4}\b", "score >= 50"),
    }
    parts = []
    for rank, (kind, (pattern, valid)) in enumerate(of.items()):
        near = f"regexp_matches(lower(right(gs[i], {CONTEXT_CHARS})), '{near_words(KINDS[rank])}') OR regexp_matches(lower(substring(t, (s + length(m) + 1)::BIGINT, {CONTEXT_CHARS})), '{near_words(KINDS[rank])}')"
        parts.append(f"""SELECT doc_id, {rank} AS rank, '{kind}' AS kind, s, s + length(m) AS e, score FROM (
  SELECT *, {KINDS[rank].score} + CASE WHEN {near} THEN {KINDS[rank].more} ELSE 0 END AS score FROM (SELECT doc_id, t, ms, gs, i, ms[i] AS m, regexp_replace(ms[i], '[^0-9]', '', 'g') AS d, replace(ms[i], ' ', '') AS c,
    coalesce(list_sum(list_transform(gs[1:i], lambda x: length(x))), 0) + coalesce(list_sum(list_transform(ms[1:i - 1], lambda x: length(x))), 0) AS s
  FROM (SELECT doc_id, t, ms, gs, unnest(range(1, len(ms) + 1)) AS i FROM (SELECT doc_id, t, regexp_extract_all(t, '{pattern}') AS ms, regexp_split_to_array(t, '{pattern}') AS gs FROM d)))
) WHERE {valid}""")
    return f"""WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents), spans AS (
{' UNION ALL '.join(parts)}
), per AS (
  SELECT doc_id, count(*) FILTER (rank = 0) AS n_email, count(*) FILTER (rank = 1) AS n_ip, count(*) FILTER (rank = 2) AS n_card, count(*) FILTER (rank = 3) AS n_phone,
    string_agg(kind || ':' || s::BIGINT || ':' || e::BIGINT, ',' ORDER BY s, rank) FILTER (rank < 4) AS base, string_agg(kind || ':' || s::BIGINT || ':' || e::BIGINT, ',' ORDER BY s, rank) AS spans,
    string_agg(kind || ':' || s::BIGINT || ':' || e::BIGINT || ':' || score, ',' ORDER BY s, rank) AS scores
  FROM spans GROUP BY doc_id
)
SELECT d.doc_id, coalesce(n_email, 0)::BIGINT AS n_email, coalesce(n_ip, 0)::BIGINT AS n_ip, coalesce(n_card, 0)::BIGINT AS n_card, coalesce(n_phone, 0)::BIGINT AS n_phone,
  sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans, coalesce(scores, '') AS scores
FROM d LEFT JOIN per USING (doc_id)"""


SQL = _sql()
