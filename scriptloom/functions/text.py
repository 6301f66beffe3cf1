"""Text functions as Column expressions, one meaning with Python's str methods.

White space is Python's: Java's Unicode class and U+001C to U+001F. A token is a run of other characters whose
normal form (case-folded, letters, digits, underscores and apostrophes only, none of the last two at the ends) isn't empty.
"""

from __future__ import annotations

import sys
from collections.abc import Callable
from functools import cache

from pyspark.sql import Column
from pyspark.sql import functions as F

#: A pattern's cheap class before && spares most characters the costly one behind it.
SPACE = r"[[^!-~]&&[\s\x1c-\x1f]]"
_PART = rf"(?U){SPACE}*[^\s\x1c-\x1f]+(?:{SPACE}+\z)?"
#: White space other than spaces; signs at words' ends, once all white space is spaces; what words lack.
_ODD_SPACE = r"(?U)[[^ -~]&&[\s\x1c-\x1f]]"
_EDGES = r"(?<![^ ])[_']+|(?<![_'])[_']++(?![^ ])"
_OTHER = r"(?U)[[^a-z]&&[^\p{L}\p{N}_'\s\x1c-\x1f]]+"


def let(x: Column, body: Callable[[Column], Column]) -> Column:
    """body(x) with x evaluated once: an expression that is used twice is written out twice, and nested ones multiply."""
    return F.get(F.transform(F.array(x), body), F.lit(0))


@cache
def _folds() -> tuple[str, str, dict[str, str], str]:
    """Case folding by character: those that fold to one character, their folds, those that fold to more; and a
    pattern of all characters but ß, which is frequent, for which lower case may not be the fold.

    Below U+0530 lower case is the fold, but for a few; beyond, whole ranges of scripts with case are suspected.
    """
    pairs = [(c, c.casefold()) for c in map(chr, range(sys.maxunicode + 1)) if not "\ud800" <= c <= "\udfff" and c.casefold() != c]
    one = [p for p in pairs if len(p[1]) == 1]
    few = "".join(a for a, b in pairs if a < "\u0530" and a != "ß" and (b != a.lower() or len(b) > 1)) + "\u03a3"
    suspected = rf"[\xb5\xc0-\x{{10ffff}}&&[{few}\u0530-\u1fff\u2100-\u2fff\ua640-\uabff\ufb00-\ufb1f\uff00-\uffef\x{{10400}}-\x{{1efff}}]]"
    return "".join(a for a, _ in one), "".join(b for _, b in one), {a: b for a, b in pairs if len(b) > 1}, suspected


def casefold(x: Column) -> Column:
    source, target, longer, suspected = _folds()
    table = F.create_map(*(F.lit(v) for pair in longer.items() for v in pair))
    each = F.translate(x, source, target)
    spelled = F.array_join(F.transform(F.split(each, ""), lambda c: F.coalesce(F.element_at(table, c), c)), "")
    rare = F.when(each.rlike(f"[{''.join(longer)}]"), spelled).otherwise(each)
    ascii_only = F.octet_length(x) == F.length(x)
    return F.when(ascii_only, F.lower(x)).when(x.rlike(suspected), rare).otherwise(F.replace(F.lower(x), F.lit("ß"), F.lit("ss")))


def strip(x: Column) -> Column:
    return F.regexp_replace(x, rf"(?U)\A{SPACE}+|{SPACE}+\z", "")


def lstrip(x: Column) -> Column:
    return F.regexp_replace(x, rf"(?U)\A{SPACE}+", "")


def rstrip(x: Column) -> Column:
    return F.regexp_replace(x, rf"(?U){SPACE}+\z", "")


def squeeze(x: Column) -> Column:
    """Runs of white space as one space, none at the ends."""
    return F.trim(F.regexp_replace(x, rf"(?U){SPACE}+", " "))


def parts(x: Column) -> Column:
    """The text in pieces of a word with the space before it; joined they give the text again."""
    return F.regexp_extract_all(x, F.lit(_PART), F.lit(0))


def normal(part: Column) -> Column:
    return F.btrim(F.regexp_replace(casefold(part), r"[^\p{L}\p{N}_']+", ""), F.lit("_'"))


def normal_parts(x: Column) -> Column:
    return F.transform(parts(x), lambda p: normal(p))


def words(x: Column) -> Column:
    """The normal forms of the tokens; none for null. The text is normalized as a whole and then split at spaces; no
    expression is evaluated a word."""
    spaced = lambda t: F.when(t.rlike(_ODD_SPACE), F.regexp_replace(t, _ODD_SPACE, " ")).otherwise(t)
    bare = lambda t: F.when(t.contains("'") | t.contains("_"), F.regexp_replace(t, _EDGES, "")).otherwise(t)
    plain = let(let(F.regexp_replace(casefold(x), _OTHER, ""), spaced), bare)
    return F.coalesce(F.array_remove(F.split(plain, " "), ""), F.array().cast("array<string>"))


def equivalent(left: Column, right: Column) -> Column:
    return words(left) == words(right)


def _token_at(x: Column, number: Column) -> Column:
    """Index of the part that holds token `number` (from 0), null if there is none."""
    places = F.transform(normal_parts(x), lambda w, i: F.when(w != "", i))
    return F.get(F.filter(places, lambda i: i.isNotNull()), number)


def trim_suffix(x: Column, n: Column, total: Column | None = None) -> Column:
    """Without its last n tokens and what follows them. total: how many tokens it has, where that is known."""
    total = F.size(words(x)) if total is None else total
    # one space fewer than tokens, and no other white space: tokens with single spaces between
    single = (F.length(x) - F.length(F.replace(x, F.lit(" "), F.lit(""))) == total - 1) & ~x.rlike(_ODD_SPACE)
    # where every part is a token, the parts need not be looked at
    cut = lambda pieces: F.when(F.size(pieces) == total, total - n).otherwise(_token_at(x, total - n))
    some = let(parts(x), lambda pieces: rstrip(F.array_join(F.slice(pieces, F.lit(1), cut(pieces)), "")))
    return F.when(n <= 0, x).when(n >= total, F.when(x.isNotNull(), "")).when(single, F.call_function("substring_index", x, F.lit(" "), total - n)).otherwise(some)


def trim_prefix(x: Column, n: Column) -> Column:
    """Without its first n tokens and what stands before the next."""
    cut, all_parts = _token_at(x, n), parts(x)
    return F.when(n <= 0, x).when(n >= F.size(words(x)), F.when(x.isNotNull(), "")).otherwise(lstrip(F.array_join(F.slice(all_parts, cut + 1, F.size(all_parts)), "")))


def boundary(x: Column, n: Column, prefix: bool, total: Column | None = None) -> Column:
    """The text of the first (or last) n tokens. total: how many tokens it has, where that is known."""
    total, all_parts = F.size(words(x)) if total is None else total, parts(x)
    k = F.least(n, total)
    if prefix:
        text = F.array_join(F.slice(all_parts, F.lit(1), _token_at(x, k - 1) + 1), "")
    else:
        text = F.array_join(F.slice(all_parts, _token_at(x, total - k) + 1, F.size(all_parts)), "")
    return F.when((total == 0) | (n <= 0), "").otherwise(strip(text))


def ends_sentence(x: Column) -> Column:
    return x.rlike(rf"""(?U)[.!?]["')\]}}]*{SPACE}*\z""")


def bounded(x: Column, limit: int) -> Column:
    return rstrip(F.substring(strip(F.coalesce(x, F.lit(""))), 1, limit))


def compact(x: Column, limit: int) -> Column:
    """Squeezed; if still longer than limit, cut before the word that crosses it, with an ellipsis."""
    shorter = lambda head: F.regexp_replace(F.regexp_replace(head, r" [^ ]*\z", ""), r"[ ,;:\-]+\z", "")
    cut = lambda head: F.concat(F.coalesce(F.nullif(shorter(head), F.lit("")), head), F.lit("…"))
    return let(squeeze(F.coalesce(x, F.lit(""))), lambda t: F.when(F.length(t) <= limit, t).otherwise(let(F.substring(t, 1, limit - 1), cut)))


def with_translation(transcript: Column, translation: Column, separator: str) -> Column:
    """A transcript, and its translation where that says something else."""
    def of(said: Column, meant: Column) -> Column:
        both = F.concat(said, F.lit(separator + "Translation: "), meant)
        other = (meant != "") & (casefold(meant) != casefold(said))
        return F.when(other, F.when(said != "", both).otherwise(meant)).otherwise(said)

    return let(F.struct(transcript.alias("said"), translation.alias("meant")), lambda t: of(t["said"], t["meant"]))


def audio_text(audio: Column) -> Column:
    return with_translation(compact(audio["transcript"], 1200), compact(audio["translation"], 1200), " ")


def visual_audio_context(audio: Column) -> Column:
    clean = lambda c: strip(F.coalesce(c, F.lit("")))
    return with_translation(clean(audio["transcript"]), clean(audio["translation"]), "\n")


def safe_stem(x: Column) -> Column:
    return F.regexp_replace(x, r"[^\p{L}\p{N}_-]", "_")


def text_or(x: Column, fallback: str = "") -> Column:
    return F.coalesce(F.nullif(strip(x), F.lit("")), F.lit(fallback))


def joined(values: Column, separator: str = ", ") -> Column:
    """The non-blank values, stripped."""
    return F.coalesce(F.array_join(F.filter(F.transform(values, lambda v: strip(v)), lambda v: v != ""), separator), F.lit(""))


def user_context(x: Column) -> Column:
    return F.nullif(squeeze(x), F.lit(""))


def labelled(values: dict[str, Column]) -> Column:
    """A line for each value that isn't null or empty, behind its label."""
    line = lambda label, v: let(v, lambda x: F.when(x != "", F.concat(F.lit(label), x)))
    return F.concat_ws("\n", *(line(label, v) for label, v in values.items()))
