"""Text expressions: tokens, hash embeddings, query context, entities, domains and contradiction signals."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce
from hashlib import md5

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.blocks import BROADCAST_ROWS
from ..sources.scratch import Scratch, spread

WORD = r"[\p{L}\p{N}_]+"
DIMENSIONS = 128


def tokens(text: Column) -> Column:
    """Lower-case words and then the bigrams of neighbours, joined by an underscore."""
    w = F.regexp_extract_all(F.lower(text), F.lit(WORD), F.lit(0))
    pairs = F.when(F.size(w) > 1, F.zip_with(F.slice(w, F.lit(1), F.size(w) - 1), F.slice(w, F.lit(2), F.size(w) - 1), lambda a, b: F.concat(a, F.lit("_"), b))).otherwise(F.array().cast("array<string>"))
    return F.concat(w, pairs)


def token_counts(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, n_tokens, n_distinct, first_token, last_token) of the tokens of each key's texts; no row without a token.

    A row is counted where it is; only rows of a key that repeats, a null one too, are cut into tokens that are shuffled.
    """
    scratch = Scratch(df.sparkSession)
    df = df.select(key, text)
    again = scratch.write(df.groupBy(key).count().filter("count > 1").select(F.col(key).alias("_again")), "again")
    few = again.count()

    def per_row(rows: DataFrame) -> DataFrame:
        rows = rows.select(key, tokens(F.col(text)).alias("_t"))
        # Through a generator, so that the tokens are cut once and not in each of the columns.
        t = rows.select(key, F.explode(F.array("_t")).alias("_t")).filter(F.size("_t") > 0)
        return t.select(key, F.size("_t").cast("long").alias("n_tokens"), F.size(F.array_distinct("_t")).cast("long").alias("n_distinct"), F.array_min("_t").alias("first_token"), F.array_max("_t").alias("last_token"))

    if not few:
        return per_row(df)
    again = F.broadcast(again) if few <= BROADCAST_ROWS else again
    same = F.col(key).eqNullSafe(F.col("_again"))
    t = df.join(again, same, "left_semi").select(key, F.explode(tokens(F.col(text))).alias("_t"))
    repeated = t.groupBy(key).agg(F.count(F.lit(1)).alias("n_tokens"), F.count_distinct("_t").alias("n_distinct"), F.min("_t").alias("first_token"), F.max("_t").alias("last_token"))
    return per_row(df.join(again, same, "left_anti")).unionByName(repeated)


def _digit(hex_text: Column, at: int) -> Column:
    """The value of one hex digit: a search in a constant, much cheaper than a change of base."""
    return F.call_function("instr", F.lit("0123456789abcdef"), F.substring(hex_text, at, 1)) - 1


def bucket(token: Column, dimensions: int = DIMENSIONS) -> Column:
    """The first 8 hex digits of the MD5, modulo `dimensions`; for a power of two their last digits decide."""
    h = F.md5(token)
    bits = dimensions.bit_length() - 1
    if dimensions != 1 << bits or bits > 28:
        return F.pmod(F.conv(F.substring(h, 1, 8), 16, 10).cast("long"), F.lit(dimensions)).cast("int")
    n = F.lit(0)
    for at in range(8 - (bits + 3) // 4 + 1, 9):
        n = n * 16 + _digit(h, at)
    return F.pmod(n, F.lit(dimensions)).cast("int")


def sign(token: Column) -> Column:
    """1 if the 9th and 10th hex digits of the MD5 are an even number, else -1."""
    return F.when(_digit(F.md5(token), 10) % 2 == 0, 1).otherwise(-1)


def hashed(words: Column, dimensions: int = DIMENSIONS) -> Column:
    """The dense array of whole-number counts per bucket of a text's lower-case words and their bigrams; all zero without any.

    Each distinct token of an Arrow batch is hashed once (as `bucket` and `sign` do) and each row is summed where it
    is, so nothing is shuffled.
    """

    @F.arrow_udf("array<int>")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for b in batches:
            out = np.zeros((len(b), dimensions), np.int32)
            flat = b.flatten()
            row = np.repeat(np.arange(len(b)), pc.fill_null(pc.list_value_length(b), 0).to_numpy(zero_copy_only=False))
            near = row[1:] == row[:-1]
            pairs = pc.binary_join_element_wise(flat[:-1], flat[1:], "_").filter(pa.array(near)) if len(flat) > 1 else flat[:0]
            for tokens_, rows in ((flat, row), (pairs, row[1:][near])):
                codes = tokens_.dictionary_encode()
                h = b"".join([md5(t.as_buffer(), usedforsecurity=False).digest() for t in codes.dictionary.cast(pa.large_binary())])
                h = np.frombuffer(h, np.uint8).reshape(-1, 16)
                at = (h[:, :4].copy().view(">u4")[:, 0] % dimensions).astype(np.int64)
                sign_ = 1 - 2 * (h[:, 4] & 1).astype(np.int8)
                code = codes.indices.to_numpy(zero_copy_only=False)
                out += np.bincount(rows * dimensions + at[code], sign_[code], out.size).astype(np.int32).reshape(out.shape)
            yield pa.ListArray.from_arrays(pa.array(np.arange(0, out.size + 1, dimensions, dtype=np.int32)), pa.array(out.ravel()))

    return run(words)


def hash_embed(df: DataFrame, key: str, text: str, out: str = "counts", dimensions: int = DIMENSIONS) -> DataFrame:
    """`df` with `out`, the dense array of whole-number counts per bucket (all zero for a text without words)."""
    words = F.regexp_extract_all(F.lower(F.coalesce(F.col(text), F.lit(""))), F.lit(WORD), F.lit(0))
    return spread(df).withColumn(out, hashed(words, dimensions))


def hash_counts(df: DataFrame, key: str, text: str, dimensions: int = DIMENSIONS) -> DataFrame:
    """(key, bucket, n): the sparse hash embedding before normalisation, in whole numbers; zeros are left out."""
    c = hash_embed(df.select(key, text), key, text, "_counts", dimensions)
    return c.select(key, F.posexplode_outer("_counts").alias("bucket", "n")).filter("n <> 0")  # outer: no filter that would run it twice


def normalised(counts: Column) -> Column:
    """Counts as a unit vector of floats; zero stays zero."""
    norm = F.sqrt(F.aggregate(counts, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))
    return F.transform(counts, lambda x: F.coalesce(F.try_divide(x.cast("double"), norm), F.lit(0.0)).cast("float"))


def strip(c: Column) -> Column:
    return F.regexp_replace(c, r"^[\s\p{Z}]+|[\s\p{Z}]+$", "")


def contextualize(query: Column, context: Column | None, max_chars: int = 2000) -> Column:
    """The stripped query after the last `max_chars` of its context; `context` is an array of lines or a string."""
    q = strip(query)
    if context is None:
        return q
    if max_chars < 0:
        raise ValueError("max_chars must not be negative")
    c = strip(F.array_join(F.filter(F.transform(context, strip), lambda x: x != ""), "\n"))
    tail = F.when(F.length(c) > max_chars, F.right(c, F.lit(max_chars))).otherwise(c)
    return q if max_chars == 0 else F.when(F.coalesce(c, F.lit("")) == "", q).otherwise(F.concat(tail, F.lit("\n"), q))


#: Entity patterns and their types, in order (fixed values).
ENTITY_PATTERNS = (
    (r"\b([A-Z][a-z]+(?:\s+[A-Z][a-z]+)+)\b", "person_or_place"),
    (r"\b([A-Z]{3,})\b", "acronym"),
    (r'"([^"]{2,50})"', "reference"),
    (r"'([^']{2,50})'", "reference"),
)
#: Categories with a domain of their own (fixed values).
CATEGORY_DOMAIN = {
    "correction": "technical", "bug": "technical", "emotion": "emotional", "relationship": "emotional",
    "belief": "identity", "value": "identity", "personality": "identity", "workflow": "procedural",
}
#: Content keywords by domain, the first domain with a hit wins (fixed values).
DOMAIN_KEYWORDS = (
    ("technical", ("API", "endpoint", "PostgreSQL", "port", "bug", "deploy", "error", "fix", "crash", "server", "database", "query", "schema", "test", "código", "función")),
    ("emotional", ("orgulloso", "preocupa", "siento", "feliz", "triste", "angry", "trust", "confianza", "proud", "worried", "happy", "emoción", "miedo", "love", "afraid")),
    ("identity", ("OCEAN", "personality", "identidad", "soy JARVIS", "soy ADA", "mi rol", "mi personalidad", "belief", "value", "principio")),
    ("procedural", ("step", "paso", "workflow", "pipeline", "sequence", "procedimiento")),
)
PROCEDURE_KEYWORDS = ("step", "paso", "workflow", "sequence", "procedimiento")
#: Signals of a contradiction if one of two texts has them, in order (fixed values).
CONTRADICTION_KEYWORDS = ("no ", "nunca", "incorrecto", "error", "falso", "wrong", "not ", "never", "incorrect", "false", "don't", "doesn't", "ya no", "antes ", "cambió", "reemplaz", "obsolet")
#: Fixed value: what keys of three services look like.
SECRET = r"(?:gsk_[A-Za-z0-9]{20,}|sk-[A-Za-z0-9]{20,}|AKIA[0-9A-Z]{16})"


def extract_entities(df: DataFrame, key: list[str], text: str) -> DataFrame:
    """(key, entity, entity_type, ordinal): each entity of a text once, whatever its case; the first pattern and place win."""
    def of(pattern: str, kind: str) -> Column:
        # A word boundary by Unicode letters, whatever the Java version takes for one.
        head, tail = (r"(?<![\p{L}\p{N}_])", r"(?![\p{L}\p{N}_])")
        if pattern.startswith(r"\b"):
            pattern = head + pattern[2:-2] + tail
        return F.transform(F.regexp_extract_all(F.col(text), F.lit(pattern), F.lit(1)), lambda x: F.struct(strip(x).alias("entity"), F.lit(kind).alias("entity_type")))

    found = F.flatten(F.array(*[of(p, kind) for p, kind in ENTITY_PATTERNS]))
    e = df.select(*key, F.posexplode(found).alias("ordinal", "e")).select(*key, "ordinal", "e.entity", "e.entity_type").filter(F.length("entity") > 1)
    return e.groupBy(*key, F.lower("entity").alias("_l")).agg(F.min(F.struct("ordinal", "entity", "entity_type")).alias("e")).select(*key, "e.entity", "e.entity_type", "e.ordinal")


def _any(text: Column, words: tuple[str, ...]) -> Column:
    return reduce(lambda a, b: a | b, [F.contains(text, F.lit(w.lower())) for w in words])


def classify_domain(category: Column, content: Column) -> Column:
    cat, text = F.lower(strip(category)), F.lower(content)
    out = F.when((cat == "procedure") & _any(text, PROCEDURE_KEYWORDS), "procedural").when(cat == "procedure", "technical")
    for c, d in CATEGORY_DOMAIN.items():
        out = out.when(cat == c, d)
    for d, words in DOMAIN_KEYWORDS:
        out = out.when(_any(text, words), d)
    return out.otherwise("general")


def contradiction(a: Column, b: Column, keywords: tuple[str, ...] = CONTRADICTION_KEYWORDS) -> Column:
    """The first keyword that exactly one of two texts holds, trimmed; null if there is none."""
    out = None
    for k in keywords:
        hit = F.contains(F.lower(a), F.lit(k)) != F.contains(F.lower(b), F.lit(k))
        out = F.when(hit, k.strip()) if out is None else out.when(hit, k.strip())
    return out


def signals(text: Column, keywords: tuple[str, ...] = CONTRADICTION_KEYWORDS) -> Column:
    """Which keywords a text holds, as the bits of a long; null for null."""
    low = F.lower(text)
    return reduce(lambda a, b: a.bitwiseOR(b), [F.when(F.contains(low, F.lit(k)), 1 << i).when(text.isNotNull(), 0).cast("long") for i, k in enumerate(keywords)], F.lit(0).cast("long"))


def contradiction_of(a: Column, b: Column, keywords: tuple[str, ...] = CONTRADICTION_KEYWORDS) -> Column:
    """`contradiction` of two texts by their `signals`."""
    out, differ = None, a.bitwiseXOR(b)
    for i, k in enumerate(keywords):
        hit = differ.bitwiseAND(F.lit(1 << i).cast("long")) != 0
        out = F.when(hit, k.strip()) if out is None else out.when(hit, k.strip())
    return out


def slug_text(name: str, default: str = "agent") -> str:
    """A name as it may stand in a path."""
    return re.sub(r"[^A-Za-z0-9_.-]+", "-", name).strip("-") or default


def slug(name: Column, default: str = "agent") -> Column:
    s = F.regexp_replace(F.regexp_replace(name, r"[^A-Za-z0-9_.-]+", "-"), r"^-+|-+$", "")
    return F.when(s == "", default).otherwise(s)


def has_secret(text: Column) -> Column:
    return F.rlike(text, F.lit(SECRET))
