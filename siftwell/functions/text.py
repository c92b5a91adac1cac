"""Scalar text functions, all native columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space as Unicode splitting has it; ``\\s`` alone would be ASCII.
SPACE = r"[\s\x1c-\x1f\x{85}\p{Z}]+"
#: ASCII punctuation, deleted from answers (fixed values).
PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
#: Words of at least two letters, digits or underscores are search terms.
TERM = r"[\p{L}\p{N}_]{2,}"
#: The short English stop list of the common BM25 libraries (fixed values).
STOP_WORDS = (
    "a an and are as at be but by for if in into is it no not of on or such that the their then there these they this to was will with"
).split()


def tokens(text: Column) -> Column:
    """White-space tokens; their positions are the token offsets used everywhere."""
    return F.filter(F.split(text, SPACE), lambda t: t != "")


def squeeze(text: Column) -> Column:
    """White space runs as one blank, none at the ends."""
    return F.trim(F.regexp_replace(text, SPACE, " "))


def normal_phrase(text: Column) -> Column:
    return squeeze(F.lower(text))


def normal_answer(text: Column) -> Column:
    """Lower case, without ASCII punctuation, then without articles, then squeezed: in this order."""
    plain = F.translate(F.lower(text), PUNCTUATION, "")
    return squeeze(F.regexp_replace(plain, r"(?U)\b(a|an|the)\b", " "))


def search_terms(text: Column, stop_words: list[str] | None = None) -> Column:
    found = F.regexp_extract_all(F.lower(text), F.lit(f"({TERM})"), F.lit(1))
    stop = STOP_WORDS if stop_words is None else stop_words
    return F.filter(found, lambda t: ~t.isin(stop))


def content_id(prefix: str, *parts: Column) -> Column:
    """A prefix and 16 hex digits of the SHA-1 of the parts, line by line."""
    return F.concat(F.lit(prefix), F.substring(F.sha1(F.concat_ws("\n", *parts)), 1, 16))


def uuid5(name: Column, namespace: str = "6ba7b8119dad11d180b400c04fd430c8") -> Column:
    """The name-based (version 5) UUID; the default namespace is that for URLs (fixed value)."""
    digest = F.sha1(F.concat(F.unhex(F.lit(namespace)), name.cast("binary")))
    variant = F.lower(F.hex(F.conv(F.substring(digest, 17, 1), 16, 10).cast("int").bitwiseAND(3).bitwiseOR(8)))
    part = lambda a, n: F.substring(digest, a, n)
    return F.concat_ws("-", part(1, 8), part(9, 4), F.concat(F.lit("5"), part(14, 3)), F.concat(variant, part(18, 3)), part(21, 12))


def approx_tokens(text: Column) -> Column:
    return F.greatest(F.lit(1), F.expr("1") * F.floor(F.length(text) / 4)).cast("int")


def numbered_context(texts: Column) -> Column:
    """``[1] first``, ``[2] second`` ... with blank lines between."""
    return F.array_join(F.transform(texts, lambda t, i: F.concat(F.lit("["), (i + 1).cast("string"), F.lit("] "), t)), "\n\n")


def citation_numbers(answer: Column) -> Column:
    return F.transform(F.regexp_extract_all(answer, F.lit(r"\[(\d+)\]"), F.lit(1)), lambda x: x.cast("int"))


def chunk_parts(chunk_id: Column) -> tuple[Column, Column]:
    """Document and position of a chunk id ``document:position``."""
    return F.regexp_extract(chunk_id, r"^(.*):(\d+)$", 1), F.regexp_extract(chunk_id, r"^(.*):(\d+)$", 2).cast("int")


def dataset_name(name: Column) -> Column:
    return F.regexp_replace(name, r"-dev-\d+$", "")


def client_address(forwarded: Column, peer: Column) -> Column:
    first = F.trim(F.split(forwarded, ",")[0])
    return F.coalesce(F.when(first != "", first), peer)


def is_slug(name: Column) -> Column:
    return name.rlike(r"^[a-z0-9][a-z0-9_-]{0,63}$")


def overlap_text(words: Column, start: Column, gold_start: Column, gold_end: Column, most: int = 240) -> Column:
    """The part of a chunk's words within a gold span, at most ``most`` characters; null if they do not meet."""
    low, high = F.greatest(start, gold_start), F.least(start + F.size(words), gold_end)
    return F.when(low < high, F.left(F.array_join(F.slice(words, (low - start + 1).cast("int"), F.greatest(high - low, F.lit(0)).cast("int")), " "), F.lit(most)))


def exact_match(prediction: Column, golds: Column) -> Column:
    own = normal_answer(prediction)
    return F.exists(golds, lambda g: normal_answer(g) == own).cast("double")


def token_f1(prediction: Column, golds: Column) -> Column:
    """The best F1 over the golds, of normalised tokens counted with repeats."""
    def words(text):
        return F.filter(F.split(normal_answer(text), " "), lambda t: t != "")

    def one(p, g):
        count = lambda xs, t: F.size(F.filter(xs, lambda x: x == t))
        same = F.aggregate(F.array_distinct(F.array_intersect(p, g)), F.lit(0), lambda acc, t: acc + F.least(count(p, t), count(g, t)))
        both_empty = (F.size(p) == 0) & (F.size(g) == 0)
        score = 2.0 * same / (F.size(p) + F.size(g))
        return F.when(both_empty, 1.0).otherwise(F.when((F.size(p) == 0) | (F.size(g) == 0), 0.0).otherwise(score))

    # the words are found once for a text: an array of one binds them, where a lambda would find them again for each word
    scores = F.flatten(F.transform(F.array(words(prediction)), lambda p: F.transform(F.transform(golds, words), lambda g: one(p, g))))
    return F.coalesce(F.array_max(scores), F.lit(0.0))


def html_body(html: Column) -> Column:
    """The text of a page's body by patterns: scripts, styles and tags out, white space squeezed."""
    body = F.coalesce(F.nullif(F.regexp_extract(html, r"(?is)<body[^>]*>(.*)", 1), F.lit("")), html)
    body = F.regexp_replace(body, r"(?is)<(script|style)[^>]*>.*?</(script|style)>", " ")
    return squeeze(F.regexp_replace(F.regexp_replace(body, r"(?s)<!--.*?-->", " "), r"<[^>]*>", " "))
