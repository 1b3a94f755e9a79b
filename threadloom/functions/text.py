"""Text rules as columns. Only normal forms beyond ASCII need Python, by Arrow batches; all else runs in the JVM."""

from __future__ import annotations

import html
import re
import unicodedata
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

# Terms that count as filler, whatever the language of the message.
FILLER_TERMS = ("cool", "great", "gracias", "好", "好的", "lol", "nice", "ok", "okay", "sí", "thanks", "thank you", "thx", "yes", "赞", "谢谢", "👍", "👌")

# Terms that carry no meaning in a language, and how short a meaningful text may be there.
LANGUAGE_FILLERS = {
    "en": ("cool", "great", "lol", "nice", "ok", "okay", "thank you", "thanks", "thx", "yes"),
    "es": ("genial", "gracias", "ok", "sí", "vale"),
    "tr": ("evet", "tamam", "teşekkür ederim", "teşekkürler"),
    "ar": ("تم", "حسنا", "شكرا", "شكراً", "نعم"),
    "zh": ("好", "好的", "收到", "明白", "谢谢", "赞"),
}
GLOBAL_FILLERS = ("👍", "👌")
MINIMUM_CHARACTERS = {"zh": 2}
DEFAULT_MINIMUM = 4

# How questions begin, what they hold and how they end.
QUESTION_MARKS = ("?", "？", "؟")
QUESTION_PREFIXES = (
    "are ", "can ", "could ", "did ", "do ", "does ", "how ", "is ", "what ", "when ", "where ", "who ", "why ", "would ",
    "cómo ", "cuándo ", "dónde ", "por qué ", "pueden ", "qué ", "أين ", "كيف ", "لماذا ", "متى ", "هل ",
)
QUESTION_PHRASES = ("是不是", "为什么", "为何", "怎么", "如何")
QUESTION_SUFFIXES = ("吗", "呢")

# Words that a retrieval query doesn't search for.
STOP_TERMS = (
    "a", "an", "and", "are", "at", "do", "does", "for", "how", "i", "in", "is", "it", "of", "on", "the", "to", "what", "when", "where",
    "which", "who", "why", "cuál", "cómo", "de", "el", "en", "es", "la", "los", "que", "qué", "un", "una",
)

# Words by which a message mentions the project.
PROJECT_TERMS = {
    "en": ("project", "product", "roadmap"),
    "es": ("proyecto", "producto", "hoja de ruta"),
    "zh": ("项目", "产品", "路线图"),
    "ar": ("مشروع", "منتج", "خارطة الطريق", "خريطة الطريق"),
}

_ASCII = r"^[\x00-\x7F]*$"


def normal_form(text: str) -> str:
    """Compatibility form, case folded, white space collapsed: what normalize() gives, for literals."""
    return " ".join(unicodedata.normalize("NFKC", text).casefold().split())


def _normal_forms(texts: pa.Array) -> pa.Array:
    return pa.array([None if t is None else normal_form(t) for t in texts.to_pylist()], pa.string())


def normalize(text: Column) -> Column:
    """Compatibility form, case folded, white space collapsed. ASCII texts stay in the JVM."""
    ascii_ = text.rlike(_ASCII)
    plain = F.trim(F.regexp_replace(F.lower(text), r"[\t-\r\x1c-\x1f ]+", " "))
    return F.when(ascii_, plain).otherwise(F.arrow_udf(_normal_forms, "string")(F.when(~ascii_, text)))


def any_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions, F.lit(False))


def is_question(norm: Column) -> Column:
    """Of normalised text: a question mark, or a language's way to begin, hold or end a question."""
    marks = [norm.contains(normal_form(m)) for m in QUESTION_MARKS]
    return any_of([*marks, *[norm.startswith(p) for p in QUESTION_PREFIXES], *[norm.contains(p) for p in QUESTION_PHRASES], *[norm.endswith(s) for s in QUESTION_SUFFIXES]])


def is_filler(norm: Column, shortest: int = 3) -> Column:
    """A filler term of any language, or a text of `shortest` characters at most."""
    return norm.isin(*FILLER_TERMS) | (F.char_length(norm) <= shortest)


def primary_language(language: Column) -> Column:
    return F.lower(F.substring_index(language, "-", 1))


def is_language_filler(norm: Column, language: Column) -> Column:
    """A filler term of the message's own language."""
    main = primary_language(language)
    own = [(main == k) & norm.isin(*v) for k, v in LANGUAGE_FILLERS.items()]
    return any_of([norm.isin(*GLOBAL_FILLERS), *own])


def is_meaningful(norm: Column, language: Column) -> Column:
    """Neither filler nor shorter than its language's least length."""
    least = reduce(lambda c, kv: c.when(primary_language(language) == kv[0], kv[1]), list(MINIMUM_CHARACTERS.items())[1:], F.when(primary_language(language) == "zh", MINIMUM_CHARACTERS["zh"])).otherwise(DEFAULT_MINIMUM)
    return ~is_language_filler(norm, language) & (F.char_length(norm) >= least)


def _bounded(term: str) -> str:
    return rf"(?U)(?<!\w){re.escape(term)}(?!\w)"


def contains_any(norm: Column, terms: tuple[str, ...]) -> Column:
    """A term with Latin letters stands as whole words, others anywhere."""
    terms = tuple(map(normal_form, terms))
    return any_of([norm.contains(t) & norm.rlike(_bounded(t)) if re.search("[a-z]", t) else norm.contains(t) for t in terms])


#: A denial and two words at most, in text whose white space is collapsed; spelled out, as Java looks back over plain alternatives only.
_DENIAL = r"\b(?:not|never|no longer|far from) "
_DENIED = "(?<!" + "|".join(_DENIAL + r"\w{1,42} " * k for k in range(3)) + ")"


def contains_undenied(norm: Column, terms: tuple[str, ...]) -> Column:
    """A term as whole words that no denial (not, never, no longer, far from) goes before, two words apart at most.

    The look back costs far more than a plain search, so only texts that hold the term at all come to it.
    """
    terms = tuple(map(normal_form, terms))
    return any_of([norm.contains(t) & norm.rlike(rf"(?U){_DENIED}(?<!\w){re.escape(t)}(?!\w)") for t in terms])


def mentions_project(norm: Column, language: Column) -> Column:
    main = F.substring_index(language, "-", 1)
    one = lambda k, t: norm.contains(t) if k == "zh" else norm.contains(t) & norm.rlike(_bounded(t))
    return any_of([(main == k) & any_of([one(k, normal_form(t)) for t in v]) for k, v in PROJECT_TERMS.items()])


def url_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(r"(?i)https?://\S+"))


def search_terms(text: Column) -> Column:
    """Distinct terms in order: folded words of two letters or more that aren't stop words, less a final s of a long ASCII word; then
    every two neighbouring Han characters."""
    words = F.transform(F.regexp_extract_all(text, F.lit(r"(?U)([\wÀ-ÿ]+)"), 1), lambda w: F.replace(F.lower(w), F.lit("ß"), F.lit("ss")))
    words = F.filter(words, lambda w: (F.char_length(w) > 1) & ~w.isin(*STOP_TERMS))
    words = F.transform(words, lambda w: F.when(w.rlike(r"^[\x00-\x7F]{4,}s$"), F.substr(w, F.lit(1), F.char_length(w) - 1)).otherwise(w))
    runs = F.regexp_extract_all(text, F.lit("([\u3400-\u9fff]{2,})"), 1)
    pairs = F.flatten(F.transform(runs, lambda r: F.transform(F.sequence(F.lit(1), F.char_length(r) - 1), lambda i: F.substr(r, i, F.lit(2)))))
    return F.array_distinct(F.concat(words, pairs))


def language_scope(languages: Column) -> Column:
    """Of a set of languages: none, the one, or all by name."""
    return F.when(F.size(languages) == 0, "no_observation").when(F.size(languages) == 1, languages[0]).otherwise(F.concat(F.lit("multilingual:"), F.array_join(F.array_sort(languages), ",")))


def words_without_marks(text: Column) -> Column:
    """Lower case, marks as spaces, white space collapsed."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(text), r"(?U)[^\w\s]", " "), r"(?U)\s+", " "))


def redact_hex(text: Column) -> Column:
    """Digests of 64 hexadecimal digits are masked."""
    return F.regexp_replace(text, r"\b[0-9a-fA-F]{64}\b", "[REDACTED_HEX]")


def _unescaped(texts: pa.Array) -> pa.Array:
    return pa.array([None if t is None else html.unescape(t).replace("\xa0", " ") for t in texts.to_pylist()], pa.string())


def html_to_text(page: Column) -> Column:
    """Text of an HTML fragment: scripts and tags go, breaks and block ends make lines, entities are read, blank lines go."""
    out = F.regexp_replace(page, r"(?is)<(script|style)\b.*?</\1\s*>", "")
    out = F.regexp_replace(out, r"(?i)<br\s*/?>|</(p|div|li|h[1-6]|tr)\s*>", "\n")
    out = F.regexp_replace(out, r"(?s)<[^>]*>", "")
    # the commonest entities in the JVM; only texts that hold others go to Python
    plain = out
    for name, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&")):
        plain = F.replace(plain, F.lit(name), F.lit(char))
    other = out.rlike(r"&(?!(?:lt|gt|quot|#39|nbsp|amp);)[#\w]")
    out = F.when(other, F.arrow_udf(_unescaped, "string")(F.when(other, out))).otherwise(plain)
    return F.array_join(F.filter(F.transform(F.split(out, "\n"), lambda x: F.trim(x)), lambda x: x != ""), "\n")


def stable_id(prefix: str, *parts: Column, length: int = 24) -> Column:
    """An id by content: the prefix and so many hexadecimal digits of the parts' digest."""
    return F.concat(F.lit(prefix), F.substring(F.sha2(F.to_json(F.array(*[p.cast("string") for p in parts])), 256), 1, length))
