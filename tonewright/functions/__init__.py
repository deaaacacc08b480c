"""Column functions: labels, genres, markup, sentences, tokens."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Classes by number.
POLARITIES = ("none", "neg", "pos")
BELIEFS = ("na", "rob", "ncb", "cb")
#: Source-name prefixes of newswire, and the genre marks inside file names.
NEWS_PREFIXES = ("AFP", "APW", "NYT")
NEWS_MARK, FORUM_MARK = "NW", "DF"

TAG = r"</?\w+[^>]*>"
SENTENCE = r"[^.!?\n]*[.!?\n]|[^.!?\n]+$"
SENTENCE_CJK = r"[^。！？\n]*[。！？\n]|[^。！？\n]+$"
#: Tags, and sentences that stop at them.
MARKED = r"<[^<>]*>|[^<>.!?\n]*[.!?\n]|[^<>.!?\n]+|[<>]"
TOKEN = r"[A-Za-z]+|[^A-Za-z]+"
WORD = r"[A-Za-z]+"
#: The paragraph patterns.
PARAGRAPH_FORUM = r">([\s\S]*?)<[^a^i][^a]"
PARAGRAPH_NEWS = r">([\s\S]*?)<"
#: Markup whose content is not text: dropped before tags are counted.
HIDDEN = r"<script[^>]*>[\s\S]*?</script>|<style[^>]*>[\s\S]*?</style>|<!--[\s\S]*?-->"


def polarity(quality: Column, toxic: Column) -> Column:
    """Sentiment class of an annotation: 1 neg, 2 pos, 0 none; null where there is no annotation."""
    return F.when(toxic == 1, 1).when(quality == 1, 2).when(quality.isNotNull() | toxic.isNotNull(), 0)


def belief(quality: Column, toxic: Column) -> Column:
    """Belief class of an annotation: 3 cb, 2 ncb, 1 rob, 0 na; null where there is none."""
    return F.when((quality == 1) & (toxic == 0), 3).when(quality == 1, 2).when(toxic == 1, 1).when(quality.isNotNull() | toxic.isNotNull(), 0)


def genre(source: Column) -> Column:
    """nw or df, from the number at the end of a source's name."""
    return F.when(F.try_to_number(F.substring(source, 4, 9), F.lit("999999999")).cast("int") % 5 == 0, "nw").otherwise("df")


def file_genre(name: Column) -> Column:
    """nw or df, from a file's name: known prefixes, or the mark at characters 5 and 6."""
    return F.when(F.substring(name, 1, 3).isin(*NEWS_PREFIXES) | (F.substring(name, 5, 2) == NEWS_MARK), "nw").otherwise("df")


def kept_for(name: Column, wanted: str) -> Column:
    """Whether a file is traversed when one genre is wanted ('both': all)."""
    if wanted == "df":
        return ~((F.substring(name, 5, 2) == NEWS_MARK) | (F.substring(name, 1, 3) == "NYT"))
    return F.substring(name, 5, 2) != FORUM_MARK if wanted == "nw" else F.lit(True)


def encode(label: Column, classes: tuple[str, ...]) -> Column:
    """Class number of a label; unknown ones are 0."""
    out = F.lit(0)
    for k, name in reversed(list(enumerate(classes))):
        out = F.when(F.lower(label) == name, k).otherwise(out)
    return out


def decode(number: Column, classes: tuple[str, ...]) -> Column:
    """Label of a class number; others are the last class."""
    out = F.lit(classes[-1])
    for k in range(len(classes) - 2, -1, -1):
        out = F.when(number == k, classes[k]).otherwise(out)
    return out


def strip_tags(text: Column, to: str = "") -> Column:
    return F.regexp_replace(text, TAG, to)


def clean_text(text: Column) -> Column:
    """Lower-case words with punctuation set apart: line breaks and <br /> go."""
    out = F.regexp_replace(F.regexp_replace(F.lower(text), "\n", ""), "<br />", " ")
    out = F.regexp_replace(out, r"([.\",()!?;:&_-])", " $1 ")
    return F.filter(F.split(out, " +"), lambda w: w != "")


def clip_pad(items: Column, size: int, pad: Column) -> Column:
    """Exactly `size` items: cut, or padded at the end."""
    return F.slice(F.concat(items, F.array_repeat(pad, size)), 1, size)


def argmax(scores: Column) -> Column:
    """Place of the greatest score from 0, the first of ties."""
    return (F.array_position(scores, F.array_max(scores)) - 1).cast("int")


def threshold_class(p: Column, t1: float = 0.1, t2: float = 0.0) -> Column:
    """2 if pos leads by over t2, else 1 if neg leads by over t1, else 0; p is [neg, pos]."""
    return F.when(p[1] - p[0] > t2, 2).when(p[0] - p[1] > t1, 1).otherwise(0)


def cut_class(value: Column, cuts: tuple[float, ...]) -> Column:
    """Half-open bins of a regression's output: the number of cuts at or below it."""
    return sum(((value >= c).cast("int") for c in cuts[1:]), (value >= cuts[0]).cast("int"))


def lexicon_class(score: Column) -> Column:
    return F.when(score >= 1, 1).otherwise(0)
