"""Text clean-up as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from siftmark.config import CleanConfig

#: White space that is stripped and that words end at, characters of a URL, and the patterns that are masked or removed.
BLANKS = "\t\n\x0b\f\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
URL = r"(?i)(?:https?://|www\.)[a-zA-Z0-9\-._~:/?#\[\]@!$&'()*+,;=%]+(?=[\s\x1c-\x1f]|$|[^\x00-\x7F])"
MENTION = r"(?U)@[a-zA-Z0-9_]{1,15}(?=\s|$|[\x{4e00}-\x{9fff}]|[^\w])"
RETWEETS = (r"(?iU)RT\s+@\w+[:：]\s*", r"(?iU)转发\s*@\w+[:：]\s*", r"(?iU)Retweet\s+@\w+[:：]\s*")


def bind(c: Column, f) -> Column:
    """f(c) with c computed once, however often f names it."""
    return F.transform(F.array(c), f)[0]


def strip(c: Column) -> Column:
    """Without white space of any kind at either end."""
    return F.btrim(c, F.lit(BLANKS))


def word_count(c: Column) -> Column:
    """Words between white space; 1 for a text without any, so that it can divide."""
    # one kind of blank is cheaper to split at than a class of thirty is to match
    return F.size(F.split(F.btrim(F.translate(c, BLANKS, " " * len(BLANKS))), " +"))


def _literal(placeholder: str) -> str:
    return placeholder.replace("\\", "\\\\").replace("$", "\\$")


def mask_urls(c: Column, placeholder: str = "[URL]") -> Column:
    """URLs that end at white space, at the end or at a character beyond ASCII; others stay."""
    return F.regexp_replace(c, URL, _literal(placeholder))


def mask_mentions(c: Column, placeholder: str = "[MENTION]") -> Column:
    """Handles of 1 to 15 characters that no letter follows."""
    return F.regexp_replace(c, MENTION, _literal(placeholder))


def strip_retweets(c: Column) -> Column:
    def without(x: Column) -> Column:
        out = x
        for p in RETWEETS:
            out = F.regexp_replace(out, p, "")
        return F.when(x.contains("@"), out).otherwise(x)

    return strip(bind(c, without))


def clean(c: Column, config: CleanConfig = CleanConfig()) -> Column:
    """The cleaned text; null for texts that are dropped (null, empty or too short before or after)."""

    def fits(x: Column) -> Column:
        ok = F.length(x) >= config.min_length
        return F.when(ok & (F.length(x) <= config.max_length), x) if config.max_length else F.when(ok, x)

    x = bind(strip(c), fits)
    if config.url_handling == "replace":
        x = mask_urls(x, config.url_placeholder)
    if config.mention_handling == "replace":
        x = mask_mentions(x, config.mention_placeholder)
    if config.retweet_handling == "extract":
        x = strip_retweets(x)
    return bind(strip(x), lambda x: F.when(F.length(x) >= F.greatest(F.lit(config.min_length), F.lit(1)), x))


def text_hash(c: Column) -> Column:
    return F.md5(c)


#: What a shortened text ends with.
TAIL = "...[截断]"


def shorten(c: Column, most: int = 1000, tail: str = TAIL) -> Column:
    """Texts of more than ``most`` characters cut there, with a tail that says so (the form a remote labeller gets)."""
    return F.when(F.length(c) > most, F.concat(F.left(c, F.lit(most)), F.lit(tail))).otherwise(c)
