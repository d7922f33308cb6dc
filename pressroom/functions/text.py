"""How a text is cut into words, sentences and shingles."""

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from pressroom.functions.arrays import let

# What counts as a word and as a sentence.
WORD = r"\p{L}+"
SENTENCE_ENDS = ".!?。！？…"
# The length from which a word counts, where a language differs from the others.
LEAST_LENGTH = 3
LEAST_LENGTHS = {"ko": 2}


def least_length(lang: Column, lengths: dict[str, int] | None = None) -> Column:
    """The length from which a word counts in each article, by its language."""
    per_lang = [F.when(lang == name, F.lit(n)) for name, n in (LEAST_LENGTHS if lengths is None else lengths).items()]
    return F.coalesce(*per_lang, F.lit(LEAST_LENGTH))


def words(lowered: Column, min_len: int | Column = 1) -> Column:
    """All runs of letters in a lower-cased text, in order."""
    found = F.regexp_extract_all(lowered, F.lit(WORD), F.lit(0))
    return found if isinstance(min_len, int) and min_len <= 1 else F.filter(found, lambda w: F.length(w) >= min_len)


def raw_sentences(text: Column) -> Column:
    """All sentences in order, untrimmed; the index is the position of the sentence.

    The same as all matches of ``[^.!?。！？…\\n]+[.!?。！？…]?``, a class that takes Java longer than all else that is
    done with a text: a line ends after each mark as at a line break, and a line of no more than a mark is none.
    """
    lines = text
    for mark in SENTENCE_ENDS:
        lines = F.replace(lines, F.lit(mark), F.lit(f"{mark}\n"))
    return F.filter(F.split(lines, "\n"), lambda x: ~x.isin("", *SENTENCE_ENDS))


def _sequences(ws: Column, width: int, made: Callable[..., Column]) -> Column:
    """``made(word, the next, ...)`` for each sequence of ``width`` words, the distinct ones."""
    starts = F.slice(ws, 1, F.greatest(F.size(ws) - (width - 1), F.lit(0)))
    return F.array_distinct(F.transform(starts, lambda w, i: made(w, *[F.get(ws, i + step) for step in range(1, width)])))


def shingles(text: Column, width: int = 3) -> Column:
    """The distinct sequences of ``width`` words; empty for a text of fewer words."""
    return let(words(F.lower(text)), lambda ws: _sequences(ws, width, lambda *seq: F.concat_ws(" ", *seq)))


def shingle_marks(text: Column, width: int = 3) -> Column:
    """``n, gs``: how many shingles a text has, and their distinct hashes.

    Where there are as many hashes as sequences, each is a shingle of its own. Only for other texts are the
    shingles made to count them: two of them may have one hash, or one may stand in the text twice.
    """

    def marks(ws: Column) -> Column:
        made = F.size(_sequences(ws, width, lambda *seq: F.concat_ws(" ", *seq)))
        return let(
            _sequences(ws, width, F.xxhash64),
            lambda gs: F.struct(
                F.when(F.size(gs) == F.size(ws) - (width - 1), F.size(gs)).otherwise(made).cast("bigint").alias("n"), gs.alias("gs")
            ),
        )

    return let(words(F.lower(text)), marks)
