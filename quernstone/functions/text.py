"""Text expressions: cleaning, tokens, stop words, shingles."""

from __future__ import annotations

import string
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# What Java's \s is. Classes list their characters one by one: Java looks those up in a table, but asks nested functions for ranges.
_SPACE = r" \t\n\x0B\f\r"

# The default English stop words of Spark ML.
STOP_WORDS = tuple(
    "i me my myself we our ours ourselves you your yours yourself yourselves he him his himself she her hers herself it its itself they them their theirs themselves what which who whom this that these those am is are was were be been being have has had having do does did doing a an the and but if or because as until while of at by for with about against between into through during before after above below to from up down in out on off over under again further then once here there when where why how all any both each few more most other some such no nor not only own same so than too very s t can will just don should now i'll you'll he'll she'll we'll they'll i'd you'd he'd she'd we'd they'd i'm you're he's she's it's we're they're i've we've you've they've isn't aren't wasn't weren't haven't hasn't hadn't don't doesn't didn't won't wouldn't shan't shouldn't mustn't can't couldn't cannot could here's how's let's ought that's there's what's when's where's who's why's would".split()
)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once and use it several times; inside a lambda a plain expression is evaluated anew each time."""
    return F.transform(F.array(value), body)[0]


def clean(text: Column) -> Column:
    """Letters, digits and white space only, lower case, trimmed; a null text is empty."""
    return F.trim(F.lower(F.regexp_replace(F.coalesce(text, F.lit("")), f"[^{_SPACE}{string.ascii_letters}{string.digits}]", "")))


def tokens(text: Column, drop_empty: bool = False) -> Column:
    """Split at each white space character; neighbouring ones give empty tokens, which count unless dropped."""
    out = F.split(text, r"\s")
    return F.filter(out, lambda w: w != "") if drop_empty else out


def without_stop_words(words: Column) -> Column:
    return F.filter(words, lambda w: ~w.isin(*STOP_WORDS))


def clean_body(text: Column) -> Column:
    """The cleaning chain of tagged documents; its order matters."""
    out = F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), "\n", " ")
    for pattern, by in (("<body>", ""), (r"[?,.$]", " "), ("\r", " "), (" +", " "), (r" reuter &#3;</body>", "")):
        out = F.regexp_replace(out, pattern, by)
    return F.trim(out)


def shingles(words: Column, k: int) -> Column:
    """Windows of ``k`` words, joined by blanks; fewer words give none."""
    none = F.array().cast("array<string>")
    joined = lambda w: F.transform(F.sequence(F.lit(1), F.size(w) - (k - 1)), lambda i: F.array_join(F.slice(w, i, k), " "))
    return let(words, lambda w: F.when(F.size(w) < k, none).otherwise(joined(w)))


def exploded_shingles(df: DataFrame, words: Column, k: int, name: str = "shingle") -> DataFrame:
    """``shingles`` as rows, repeated ones included, in compiled code.

    The explode is an outer one because Spark filters the input of an inner one first, which would evaluate ``words`` twice.
    """
    first = F.slice("_w", 1, F.greatest(F.size("_w") - (k - 1), F.lit(0)))
    rows = df.select("*", words.alias("_w")).select("*", F.posexplode_outer(first).alias("_i", "_first")).where("_first is not null")
    return rows.select(*df.columns, F.concat_ws(" ", "_first", *(F.col("_w")[F.col("_i") + i] for i in range(1, k))).alias(name))


def clean_strict(text: Column) -> Column:
    """Lower case without handles, links, tags, signs and digits; for bags of words."""
    out = F.lower(F.coalesce(text, F.lit("")))
    for pattern in (r"@\w+", r"http\S+", r"<[^>]*>", f"[^{_SPACE}{string.ascii_lowercase}]"):
        out = F.regexp_replace(out, pattern, " ")
    return F.trim(F.regexp_replace(out, r"\s+", " "))
