"""Text expressions: normalisation, identifiers, tokens, token estimates, previews. All run inside the JVM."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import fixed

#: The characters that count as white space at the edges of a text.
SPACE = r"[\s\x1c-\x1f\x85\p{Z}]"
LINE_END = r"\n\x0b\f\r\x1c-\x1e\x85\u2028\u2029"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value computed once a row."""
    return F.element_at(F.transform(F.array(value), body), 1)


def strip(text: Column) -> Column:
    return F.regexp_replace(text, rf"\A{SPACE}+|{SPACE}+\z", "")


def normalize_text(text: Column, newlines: bool = True, blank_lines: bool = True) -> Column:
    """The canonical text that every offset refers to."""
    out = F.replace(text, F.lit("\ufeff"), F.lit(""))
    if newlines:
        out = F.regexp_replace(out, "\r\n|\r", "\n")
    out = F.regexp_replace(out, r"(?md)[ \t]+$", "")
    out = F.regexp_replace(out, r"(?md)^[ \t]*[-=*_]{6,}[ \t]*$", "")
    out = F.regexp_replace(out, rf"(?mdi)^[ \t]*(?:{'|'.join(fixed.AD_LINE_STARTS)}).*$", "")
    if blank_lines:
        out = F.regexp_replace(out, r"\n{3,}", "\n\n")
    return let(strip(out), lambda t: F.when(t != "", F.concat(t, F.lit("\n"))).otherwise(""))


def normalization_report(text: Column) -> Column:
    """The normalised text with what normalisation did: (text, raw_chars, normalized_chars, chars_removed)."""

    def tell(done: Column) -> Column:
        return F.struct(done.alias("text"), F.length(text).alias("raw_chars"), F.length(done).alias("normalized_chars"), (F.length(text) - F.length(done)).alias("chars_removed"))

    return let(normalize_text(text), tell)


def document_id(normalized: Column) -> Column:
    return F.concat(F.lit("doc_"), F.left(F.sha2(normalized, 256), F.lit(12)))


def uuid5_hex(name: Column) -> Column:
    """32 hex digits of a version-5 UUID in the URL namespace."""
    digest = F.sha1(F.concat(F.unhex(F.lit("6ba7b8119dad11d180b400c04fd430c8")), F.encode(name, "utf-8")))
    variant = F.substring(F.lit("89ab"), F.conv(F.substring(digest, 17, 1), 16, 10).cast("int") % 4 + 1, F.lit(1))
    return F.concat(F.substring(digest, 1, 12), F.lit("5"), F.substring(digest, 14, 3), variant, F.substring(digest, 18, 15))


def tokens(text: Column) -> Column:
    """Search tokens: of runs of CJK characters all 1-, then 2-, then 3-grams; other words in lower case."""
    runs = F.regexp_extract_all(text, F.lit(r"[一-鿿]+|[A-Za-z0-9_]+"), F.lit(0))

    def of_size(run: Column, n: int) -> Column:
        each = F.transform(F.sequence(F.lit(1), F.length(run) - n + 1), lambda i: F.substring(run, i, F.lit(n)))
        return F.when(F.length(run) >= n, each).otherwise(F.array().cast("array<string>"))

    def grams(run: Column) -> Column:
        return F.when(run.rlike(r"^[一-鿿]"), F.concat(*(of_size(run, n) for n in (1, 2, 3)))).otherwise(F.array(F.lower(run)))

    return F.flatten(F.transform(runs, grams))


def distinct_tokens(text: Column) -> Column:
    return F.array_distinct(tokens(text))


def estimate_prompt_tokens(text: Column) -> Column:
    """CJK characters, and other words or signs."""
    return F.greatest(F.lit(1), F.size(F.regexp_extract_all(text, F.lit(r"[一-鿿]"), F.lit(0))) + F.size(F.regexp_extract_all(F.regexp_replace(text, r"[一-鿿]", " "), F.lit(r"[A-Za-z0-9_]+|[^\sA-Za-z0-9_]"), F.lit(0))))


def estimate_quarter_tokens(text: Column) -> Column:
    return F.greatest(F.lit(1), F.ceil(F.length(text) / 4)).cast("int")


def estimate_answer_tokens(text: Column) -> Column:
    return F.greatest(F.lit(1), F.floor(F.length(text) / 4)).cast("int")


def estimate_block_tokens(text: Column, citation: Column, title: Column) -> Column:
    return F.length(text) + F.length(citation) + F.length(title)


def preview(text: Column, limit: int) -> Column:
    """White space as single blanks, cut to `limit` with an ellipsis inside it."""
    one = strip(F.regexp_replace(text, rf"{SPACE}+", " "))
    return F.when(F.length(one) <= limit, one).otherwise(F.concat(F.substring(one, 1, limit - 3), F.lit("...")))


def chapter_number(chapter_id: Column) -> Column:
    return F.coalesce(F.nullif(F.regexp_extract(chapter_id, r"ch(\d+)", 1), F.lit("")).cast("int"), F.lit(0))


def embedding_input(summary: Column, entities: Column, key_quote: Column | None = None, located_text: Column | None = None) -> Column:
    parts = [F.concat(F.lit("summary: "), summary), F.concat(F.lit("entities: "), F.array_join(entities, ", "))]
    for name, part in (("key_quote", key_quote), ("located_text", located_text)):
        if part is not None:
            parts.append(F.when(part != "", F.concat(F.lit(f"{name}: "), part)))
    return F.concat_ws("\n", *parts)


def cache_key(provider: str, model: str, dimensions: int | None, text: Column) -> Column:
    head = F.lit(f"{provider}:{model}:{dimensions or 'auto'}:")
    return F.sha2(F.concat(head, F.sha2(text, 256)), 256)


def contains_any(text: Column, words: tuple[str, ...]) -> Column:
    out = F.lit(False)
    for word in words:
        out = out | text.contains(word)
    return out
