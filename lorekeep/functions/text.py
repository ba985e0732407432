"""Scalar text functions as Spark columns: folding, tokens, budgets, slugs, hashed features."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words that carry no content in a query (English, Vietnamese).
STOPWORDS = """
a an the and or but if then else when while of at by for with about against
between into through during before after above below to from up down in out on
off over under again further once here there all any both each few more most
other some such no nor not only own same so than too very can will just should
now is are was were be been being have has had do does did doing would could as
until because how where why what which who whom this that these those it its
và là của có ở cho với những các một này đó khi thì mà nhưng nếu vì nên rồi đã
đang sẽ được cũng như từ đến trong ngoài trên dưới ra vào lên xuống rất quá lắm
không chưa chẳng đừng hãy nữa lại còn về theo bởi tại do nơi ai gì sao nào đây
kia ấy nó họ chúng tôi ta bạn mình anh chị em ông bà thầy cô người
""".split()

# Substrings of a lower-cased query that show what it asks for.
CONTINUITY_HINTS = [
    "hiện tại", "bây giờ", "gần đây", "mới nhất", "cuối cùng", "sau cùng", "chuyện gì", "điều gì", "tiếp theo", "trước đó",
    "đã xảy ra", "kết thúc", "latest", "current", "recently", "so far", "last chapter", "previously", "what happened", "next",
    "continue", "tiếp tục",
]
DESCRIPTION_HINTS = [
    "ngoại hình", "tính cách", "trông như", "mô tả", "là ai", "là gì", "appearance", "personality", "describe", "who is",
    "what is", "looks like",
]

# FNV-1a offset and prime, seeds of the bucket and of the sign, dimensions and weights of hashed features.
FNV_PRIME, INDEX_SEED, SIGN_SEED, HASH_DIMS = 0x01000193, 0x9747B28C, 0x3C6EF372, 384
FNV_OFFSET = 0x811C9DC5
WORD_WEIGHT, STOP_WEIGHT, TRIGRAM_WEIGHT, BIGRAM_WEIGHT = 1.0, 0.2, 0.35, 0.5


def _decompositions() -> tuple[str, str]:
    """Letters of the basic plane that decompose to one base character and marks, and those bases."""
    source, target = [], []
    for code in range(0x80, 0x10000):
        c = chr(code)
        if 0xD800 <= code < 0xE000 or unicodedata.combining(c):
            continue
        base = [x for x in unicodedata.normalize("NFD", c) if not unicodedata.combining(x)]
        if len(base) == 1 and base[0] != c and len(unicodedata.normalize("NFD", c)) > 1:
            source.append(c)
            target.append(base[0])
    return "".join(source) + "đĐ", "".join(target) + "dd"


ACCENTED, PLAIN = _decompositions()


def fold_text(text: str) -> str:
    """Lower-cased without accents, in plain Python (for constants)."""
    table = dict(zip(map(ord, ACCENTED), PLAIN))
    return "".join(c for c in text.lower().translate(table) if not unicodedata.combining(c))


FOLDED_STOPWORDS = sorted({fold_text(w) for w in STOPWORDS} | set(STOPWORDS))


def _col(x: str | Column) -> Column:
    return F.col(x) if isinstance(x, str) else x


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with value computed once: an expression written twice in a lambda is computed twice."""
    return F.get(F.transform(F.array(value), use), 0)


def strip(x: str | Column) -> Column:
    """Without Unicode white space at both ends; a text whose ends are none, as most, is not searched for it."""
    x = _col(x)
    ends = F.concat(F.substring(x, 1, 1), F.substring(x, -1, 1))
    return F.when(ends.rlike(r"(?U)\s"), F.regexp_replace(x, r"(?U)^\s+|\s+$", "")).otherwise(x)


def fold(x: str | Column) -> Column:
    """Lower-cased, accents removed; plain ASCII takes the short way."""
    x = _col(x)
    return F.when(F.length(x) == F.octet_length(x), F.lower(x)).otherwise(F.regexp_replace(F.translate(F.lower(x), ACCENTED, PLAIN), r"[\u0300-\u036f]", ""))


def canonical(x: str | Column) -> Column:
    return fold(strip(x))


def tokens(x: str | Column, shortest: int = 1) -> Column:
    """Folded word tokens of so many characters at least; single characters only if digits. Combining marks split words, as
    folding follows tokenizing."""
    x = F.coalesce(_col(x), F.lit(""))
    plain = F.when(F.length(x) == F.octet_length(x), F.lower(x)).otherwise(F.translate(F.lower(x), ACCENTED, PLAIN))
    # the first choice takes any longer run as a whole, so the second one meets single characters only
    return F.regexp_extract_all(plain, F.lit(r"[\p{L}\p{N}]{%d,}" % max(shortest, 2) + (r"|\p{Nd}" if shortest < 2 else "")), F.lit(0))


def content_tokens(x: str | Column) -> Column:
    """tokens() without stopwords; a token counts as one in its accented or its folded spelling."""
    stop = F.array(*[F.lit(w) for w in FOLDED_STOPWORDS])
    return F.filter(tokens(x), lambda t: ~F.array_contains(stop, t))


def estimate_tokens(x: str | Column) -> Column:
    """Model tokens that a text takes: 3.6 characters each, down to 1.8 the more of them are not ASCII."""
    x = _col(x)
    n = F.length(x)
    other = F.when(n == F.octet_length(x), F.lit(0)).otherwise(F.length(F.regexp_replace(x, r"[\x00-\x7F]+", "")))
    return F.when(n == 0, F.lit(0)).otherwise(F.greatest(F.lit(1), F.floor(n / (F.lit(3.6) - F.lit(1.8) * F.least(other / n * 4.0, F.lit(1.0)))))).cast("long")


def fnv1a(x: str | Column, seed: int = 0) -> Column:
    """32-bit FNV-1a over the low byte of each code point, from the offset mixed with a seed."""
    start = F.lit(FNV_OFFSET ^ seed).cast("bigint")
    return F.aggregate(
        F.split(_col(x), ""), start, lambda h, c: (h.bitwiseXOR(F.ascii(c).cast("bigint").bitwiseAND(F.lit(255).cast("bigint"))) * FNV_PRIME).bitwiseAND(F.lit(0xFFFFFFFF).cast("bigint"))
    )


def slugify(x: str | Column, limit: int = 48, default: str = "novel") -> Column:
    """Folded, runs of other characters as one dash, no dash at the ends, cut to limit."""
    s = F.regexp_replace(fold(x), r"[^a-z0-9]+", "-")
    s = F.regexp_replace(s, r"^-+|-+$", "")
    s = F.regexp_replace(F.substring(s, 1, limit), r"-+$", "")
    return F.when(s == "", default).otherwise(s)


def word_count(x: str | Column) -> Column:
    return F.size(words(x)).cast("long")


def words(x: str | Column) -> Column:
    """Runs of characters that are not white space."""
    return F.regexp_extract_all(F.coalesce(_col(x), F.lit("")), F.lit(r"(?U)\S+"), F.lit(0))


def output_budget(n_words: Column) -> Column:
    """Tokens to allow for a text of so many words."""
    return F.least(F.greatest(F.floor(n_words * F.lit(2.4) * F.lit(1.2)), F.lit(1024)), F.lit(16384)).cast("long")


def rough_tokens(x: str | Column) -> Column:
    return F.greatest(F.floor(F.length(_col(x)) / 3), word_count(x)).cast("long")


# What stands for the words left out, and device names that no file may have.
TRUNCATED = "\n\n[... middle truncated for token budget ...]\n\n"
RESERVED = r"(?i)^(con|prn|aux|nul|com[1-9]|lpt[1-9])(\..*)?$"


def fit_draft(x: str | Column, budget: int) -> Column:
    """A draft over budget keeps the first and last half of the words that three quarters of the budget allow."""
    half = int(budget * 0.75) // 2
    w = words(x)
    cut = F.concat(F.array_join(F.slice(w, 1, half), " "), F.lit(TRUNCATED), F.array_join(F.slice(w, F.greatest(F.size(w) - half, F.lit(0)) + 1, F.lit(half)), " "))
    return F.when(rough_tokens(x) <= budget, _col(x)).otherwise(cut)


def intent(x: str | Column) -> Column:
    low = F.lower(_col(x))

    def any_of(hints: list[str]) -> Column:
        return low.rlike("|".join(hints))

    return F.when(any_of(CONTINUITY_HINTS), "continuity").when(any_of(DESCRIPTION_HINTS), "description").otherwise("general")


def safe_name(x: str | Column) -> Column:
    """Whether a file name names a plain child: no separators, no leading dot, no reserved device name."""
    x = _col(x)
    return (F.length(x) > 0) & (F.length(x) <= 255) & ~x.rlike(r"[/\\\x00:]") & ~x.startswith(".") & ~x.rlike(RESERVED)


def title_of(x: str | Column) -> Column:
    return F.regexp_replace(F.get(F.split(_col(x), "\n"), 0), r"^[# ]+", "")


def chapter_slug(x: str | Column) -> Column:
    """Lower-cased, accents kept, runs of other characters as one dash, cut to 40."""
    s = F.regexp_replace(F.lower(_col(x)), r"[^\p{L}\p{N}_]+", "-")
    return F.substring(F.regexp_replace(s, "^-+|-+$", ""), 1, 40)


def chapter_number(name: str | Column) -> Column:
    """All digits of a name, joined, as a number; null without any."""
    return F.try_to_number(F.nullif(F.regexp_replace(_col(name), r"[^0-9]", ""), F.lit("")), F.lit("9" * 18)).cast("bigint")
