"""Texts as units: pieces that start where a space or a line feed follows a sign that is no white space.

Both kinds of tokenizers used here cut a text there, whatever stands around: the pattern that splits before byte-level
merges has no alternative with white space after other signs, and no entry of the piece vocabulary has a space mark or a
line feed after another sign. So a text's tokens are its units' tokens, and a unit is encoded once however often it stands.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .base import walked

#: White space inside a unit is that of its start, and any other than spaces and line feeds with what follows.
_unit = re.compile(r"\s*\S+(?:[^\S \n]\s*\S*)*|\s+")
#: Texts with other white space than single spaces and line feeds go through the pattern above, the rest through Arrow.
_ODD = "[ \\n][ \\n]|[\\t\\r\\x0b\\x0c\\x1c-\\x1f\\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}]"


def found(text: str) -> list[str]:
    """The units of one text, in order."""
    return _unit.findall(text)


def split(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """Units of all texts by number, in a row; how many each text has; the distinct units. Null texts have none."""
    texts = pc.fill_null(texts, "")
    odd = pc.match_substring_regex(texts, _ODD).to_numpy(zero_copy_only=False)
    plain = pc.split_pattern(pc.replace_substring(texts.filter(pa.array(~odd)), "\n", " \n"), " ")
    flat = plain.flatten().dictionary_encode()
    parts, code = flat.dictionary.to_pylist(), flat.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    at = plain.offsets.to_numpy().astype(np.int64)
    # a part has lost the space before it, unless it begins its text or with a line feed
    units = [p if p[:1] == "\n" else " " + p for p in parts]
    first, place = np.unique(code[at[:-1] - at[0]], return_inverse=True)
    code[at[:-1] - at[0]] = len(units) + place
    units += [parts[i] for i in first.tolist()]
    size = np.empty(len(texts), np.int64)
    size[~odd] = np.diff(at)
    if not odd.any():
        return code.astype(np.int32), size, units
    number: dict[str, int] = {}
    others = [[number.setdefault(u, len(number)) for u in found(t)] for t in texts.filter(pa.array(odd)).to_pylist()]
    size[odd] = [len(x) for x in others]
    pool = np.concatenate([code, *(np.array(x, np.int64) + len(units) for x in others)])
    runs = np.concatenate([np.diff(at), size[odd]])
    order = np.argsort(np.concatenate([np.flatnonzero(~odd), np.flatnonzero(odd)]))
    return walked(pool, runs, order).astype(np.int32), size, units + list(number)
