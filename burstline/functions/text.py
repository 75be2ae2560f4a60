"""Cleaners, tokenizers, n-grams and affixes as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The default stop list: function words of English.
STOP_WORDS = (
    "a about after all also an and any are as at be because been but by can could did do does for from had has have he her him his how i if in "
    "into is it its just like me more most my no not now of on one only or other our out over she so some than that the their them then there "
    "these they this those to too under up us very was we were what when where which who why will with would you your"
).split()


def words(text: Column) -> Column:
    """Lower-case runs of ASCII letters and digits."""
    return F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]+"), F.lit(0))


def collapse(text: Column) -> Column:
    """White space to single spaces, doubled backslashes to single ones."""
    return F.replace(F.regexp_replace(text, r"\s+", " "), F.lit("\\\\"), F.lit("\\"))


def split_spaces(text: Column) -> Column:
    return F.filter(F.split(text, r"\s+"), lambda t: t != "")


def joined(tokens: Column, by: str = " ") -> Column:
    return F.array_join(tokens, by)


def collapse_underscores(text: Column) -> Column:
    """Runs of _ to one, none at the ends."""
    return F.regexp_replace(F.regexp_replace(text, "_+", "_"), "^_|_$", "")


def unescape(text: Column) -> Column:
    """Backslash escapes of white space and quotes to spaces, other backslashes away."""
    return F.regexp_replace(F.regexp_replace(text, r'\\[tsnr"]', " "), r"\\", "")


def cut_tokens(text: Column) -> Column:
    """Tokens cut at the first @ and then the first #; empty ones and "rt" go."""
    cut = F.transform(F.split(text, r"\s+"), lambda t: F.substring_index(F.substring_index(t, "@", 1), "#", 1))
    return F.filter(cut, lambda t: (t != "") & (F.lower(t) != "rt"))


def social_tokens(text: Column, stop_words: list[str] | tuple[str, ...] = (), legacy: bool = False) -> Column:
    """Without mentions, links, retweet marks and hashtags; lower-cased; no stop words, single characters or bare underscores.

    A retweet mark is a word of its own; with legacy=True any "rt" before white space goes, also
    at the end of a longer word.
    """
    out = F.regexp_replace(text, "_+", "_")
    out = F.regexp_replace(out, r"@\w+", " ")
    out = F.regexp_replace(out, r"https?://\S+", " ")
    out = F.regexp_replace(out, r"[rR][tT]\s+" if legacy else r"(^|\s)[rR][tT](\s+|$)", " ")
    out = F.lower(F.regexp_replace(out, r"#[A-Za-z0-9{}]+", " "))
    keep = F.filter(F.split(out, r"\s+"), lambda t: (F.length(t) > 1) & ~t.rlike("^_+$"))
    return F.filter(keep, lambda t: ~t.isin(list(stop_words))) if stop_words else keep


def clean_tokens(text: Column, hashtags: Column | None = None, stop_words: list[str] | tuple[str, ...] = STOP_WORDS) -> Column:
    """Tokens of a message: links go; mentions keep [@A-Za-z0-9]; listed hashtags stay as they are if ASCII; of the rest
    the printable ASCII ones, without outer punctuation, of two characters or more, that are no stop words."""
    plain = lambda t: ~t.rlike("[^ -~]")

    def stripped(t: Column) -> Column:
        """The token and what is left of it without outer punctuation: null if it isn't plain, and itself, which most are, if it has letters and digits only."""
        bare = F.regexp_replace(F.replace(F.replace(t, F.lit("&lt;"), F.lit("<")), F.lit("&gt;"), F.lit(">")), "^[^a-zA-Z0-9]+|[^a-zA-Z0-9]+$", "")
        return F.struct(t.alias("t"), F.when(~t.rlike("[^a-zA-Z0-9]"), t).when(plain(t), bare).alias("bare"))

    def one(s: Column) -> Column:
        t, bare = s["t"], s["bare"]
        word = F.when((F.length(bare) >= 2) & ~bare.isin(list(stop_words)), bare)  # two characters that are left have a letter or digit
        word = F.when(F.contains(t, F.lit("@")), F.regexp_replace(t, "[^@a-zA-Z0-9]", "")).otherwise(word)
        return F.when(F.array_contains(hashtags, t), F.when(plain(t), t)).otherwise(word) if hashtags is not None else word

    tokens = F.filter(split_spaces(text), lambda t: ~F.startswith(t, F.lit("http")))
    return F.filter(F.transform(F.transform(tokens, stripped), one), lambda t: t.isNotNull())


def ngrams(tokens: Column, longest: int = 5, by: str = " ") -> Column:
    """All 1..longest-grams, in order of place and then length, as (at, n, gram); none of no tokens."""
    size = F.size(tokens)
    at = lambda i: F.transform(F.sequence(F.lit(1), F.least(F.lit(longest), size - i)), lambda n: F.struct(i.alias("at"), n.alias("n"), F.array_join(F.slice(tokens, i + 1, n), by).alias("gram")))
    return F.when(size > 0, F.flatten(F.transform(F.sequence(F.lit(0), size - 1), at))).otherwise(F.array().cast("array<struct<at:int,n:int,gram:string>>"))


def subgrams(tokens: Column, by: str = " ") -> Column:
    """The set of all contiguous sub-grams."""
    size = F.size(tokens)
    return F.array_distinct(F.flatten(F.transform(F.sequence(F.lit(1), F.greatest(size, F.lit(1))), lambda i: F.transform(F.sequence(F.lit(1), F.greatest(size - i + 1, F.lit(1))), lambda n: F.array_join(F.slice(tokens, i, n), by)))))


def hashtags(text: Column) -> Column:
    """From # to the end of each token that holds one."""
    return F.filter(F.transform(split_spaces(text), lambda t: F.regexp_extract(t, r"#\S*", 0)), lambda t: F.length(t) > 0)


def prefixes(tag: Column) -> Column:
    """Beginnings of a tag without its #, of every length."""
    return _affixes(tag, lambda body, i: F.substring(body, F.lit(1), i))


def suffixes(tag: Column) -> Column:
    """Endings of a tag without its #, of every length."""
    return _affixes(tag, lambda body, i: F.substring(body, F.length(body) - i + 1, i))


def _affixes(tag: Column, cut) -> Column:
    body = F.substring(tag, F.lit(2), F.length(tag))
    return F.when(F.length(body) > 0, F.transform(F.sequence(F.lit(1), F.greatest(F.length(body), F.lit(1))), lambda i: cut(body, i))).otherwise(F.array().cast("array<string>"))


def one_character(s: Column) -> Column:
    """Whether a string is one character over and over."""
    return s.rlike(r"^(.)\1*$")


#: Short forms that stand for longer words in news matching.
FORMS = {"est": "estimate", "rev": "revenue"}


def normal_form(word: Column, forms: dict[str, str] = FORMS) -> Column:
    out = word
    for a, b in forms.items():
        out = F.when(word == a, b).otherwise(out)
    return out


def is_retweet(text: Column) -> Column:
    return (F.length(text) > 5) & F.startswith(F.lower(text), F.lit("rt @"))


def is_reply(text: Column) -> Column:
    return F.startswith(text, F.lit("@"))


def past_words(tokens: Column) -> Column:
    """Words that end in "ed"."""
    return F.filter(tokens, lambda t: t.rlike("..ed$"))


def message_time(created_at: Column) -> Column:
    """Sun Jan 23 00:00:02 +0000 2011; the day's name is skipped."""
    return F.to_timestamp(F.substring(created_at, F.lit(5), F.length(created_at)), "MMM dd HH:mm:ss Z yyyy")


def subwindow(hour: Column, m: int = 12) -> Column:
    """Which of m equal parts of the day an hour is in."""
    return F.floor(hour / F.lit(24 // m)).cast("int")


def padded(number: Column, width: int = 3) -> Column:
    return F.lpad(number.cast("string"), width, "0")
