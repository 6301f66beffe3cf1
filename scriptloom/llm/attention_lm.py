"""A small causal self-attention language model over subword ids, in numpy.

Subwords: the first VOCAB - 1 entries of a public byte-level vocabulary (any beginning of a merge list is itself a
byte-pair vocabulary), and an end mark. Each word is spelled with a space before it; a text is its words' subwords
and the end mark, so the model gives every sequence of words a probability.

A token is predicted in three steps down a tree of tokens that occur beside the same others: one of 16 branches, one of
its 16 twigs, one of its 8 tokens. Each step has logits of a corpus-wide bigram table plus a causal self-attention head
over the context. Texts are cut into windows of CONTEXT positions that
overlap by CONTEXT - STRIDE: each token is scored once, in the window where it is among the last STRIDE positions,
and attends to all earlier ones there. Windows are scored in batches under one causal mask.
"""

from __future__ import annotations

import base64
import math
import zlib
from array import array
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .base import walked

VOCABULARY, VOCAB = "byte_bpe_multi_50k.tiktoken", 2048
END = VOCAB - 1
#: Choices at each step, and where each step's logits begin.
STEPS, EDGES = (16, 16, 8), (0, 16, 32, 40)
CONTEXT, STRIDE, WIDTH = 32, 16, 16
#: Causal mask of the last STRIDE queries over CONTEXT keys.
MASK = np.where(np.arange(CONTEXT)[None, :] <= (np.arange(STRIDE) + CONTEXT - STRIDE)[:, None], 0, -1e9).astype(np.float32)
#: 1 where a logit belongs to a step.
OF_STEP = np.repeat(np.eye(len(STEPS), dtype=np.float32), STEPS, axis=0)
#: Each subword's pairs of columns.
PAIRS = np.arange(VOCAB * WIDTH // 2).reshape(VOCAB, -1)
SHAPES = {
    "token": (VOCAB, WIDTH), "place": (CONTEXT, WIDTH), "q": (WIDTH, WIDTH), "k": (WIDTH, WIDTH), "v": (WIDTH, WIDTH), "out": (WIDTH, WIDTH),
    "choice": (WIDTH, EDGES[-1]),
}


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class Spelled:
    """Subword ids (16-bit integers) of words, one word's after the other's, and how many each has."""

    def __init__(self, flat: np.ndarray, size: np.ndarray):
        self.flat, self.size = flat, size

    def __iter__(self):
        return (x.tobytes() for x in np.split(self.flat, np.cumsum(self.size)[:-1]))


class Speller:
    """Words (bytes) to their subword ids; the distinct words of many texts are spelled in one call. None are kept (`kept`
    does nothing any more): most are rare, and to look up and store each took longer than to spell it."""

    def __init__(self, path: str, kept: int = 0):
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        ranks = {k: v for k, v in ranks.items() if v < END}
        # words hold no space, so a subword that begins with one begins a word
        self._code = tiktoken.Encoding("subwords", pat_str=" [^ ]+", mergeable_ranks=ranks, special_tokens={})
        self._begins = np.zeros(VOCAB, bool)
        self._begins[[v for k, v in ranks.items() if k[:1] == b" "]] = True

    def _spelled(self, words: list[bytes]) -> Spelled:
        try:
            ids = self._code.encode_to_numpy(b" ".join([b"", *words]).decode()).astype("<u2")
        except UnicodeDecodeError:  # some word isn't UTF-8
            each = [self._code._core_bpe.encode_single_piece(b" " + w) for w in words]
            return Spelled(np.array([i for x in each for i in x], "<u2"), np.array([len(x) for x in each], np.int32))
        return Spelled(ids, np.diff(np.flatnonzero(self._begins.take(ids)), append=len(ids)).astype(np.int32))

    def spell(self, words: "Words") -> list[np.ndarray]:
        """The subwords of each text."""
        named = words.kinds[:-1]
        if words.blank:
            named[named.index(b"")] = b"-"  # stands in no text
        kinds = self._spelled(named)
        flat, size = np.append(kinds.flat, np.array([END], "<u2")), np.append(kinds.size, np.int32(1))
        flat = walked(flat, size, words.kind)
        return np.split(flat, np.cumsum(size[words.kind], dtype=np.int64)[words.ends - 1][:-1]) if len(words.ends) else []


@lru_cache(1)
def speller(path: str) -> Speller:
    """One for each worker."""
    return Speller(path)


class Words:
    """The words of texts, each text followed by the end: distinct ones (kinds, the end last, as b""), the number of each
    word among them (kind), where each text ends (ends), and whether kinds holds another b"", which is no word (blank)."""

    def __init__(self, texts: pa.Array):
        split = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts, "")))
        first = split.offsets.to_numpy().astype(np.int64)
        numbered = split.flatten().dictionary_encode()
        self.kinds = [*numbered.dictionary.cast(pa.binary()).to_numpy(zero_copy_only=False).tolist(), b""]
        kind = np.insert(numbered.indices.to_numpy(zero_copy_only=False), first[1:] - first[0], len(self.kinds) - 1)
        ends = first[1:] - first[0] + np.arange(1, len(texts) + 1)
        blank = self.kinds.index(b"")  # before and behind white space
        self.blank = blank < len(self.kinds) - 1
        if self.blank:
            real = kind != blank
            kind, ends = kind[real], np.cumsum(real)[ends - 1]
        self.kind, self.ends = kind, ends


def windows(docs: list[np.ndarray], every: int = 1, skip: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """inputs (n, CONTEXT): the tokens before each position, END standing before the first and as padding;
    wanted (n, STRIDE): the tokens to score, VOCAB where there is none; owner: each window's document; and how many
    windows there are, of which each every-th from number skip on is returned."""
    size = np.array([len(d) for d in docs], np.int64)
    many = -(-size // STRIDE)
    first = np.concatenate([[0], np.cumsum(many)])
    # rows of END before each document, as many as the first window reaches back, and END up to a whole row behind it
    lead = -(-(CONTEXT - STRIDE + 1) // STRIDE)
    blank = np.full(STRIDE, END, "<u2")
    flat = np.concatenate([x for d in docs for x in (*[blank] * lead, d, blank[: -len(d) % STRIDE])] + [blank, blank])
    number = np.arange(skip, first[-1], every)
    owner = np.searchsorted(first, number, side="right") - 1
    row = number + (owner + 1) * lead
    inputs = np.lib.stride_tricks.sliding_window_view(flat, CONTEXT)[row * STRIDE - (CONTEXT - STRIDE + 1)].astype(np.int32)
    wanted = flat.reshape(-1, STRIDE)[row].astype(np.int32)
    left = size[owner] - (number - first[owner]) * STRIDE
    short = np.flatnonzero(left < STRIDE)
    wanted[short] = np.where(np.arange(STRIDE) < left[short, None], wanted[short], VOCAB)
    return inputs, wanted, owner, int(first[-1])


class Bigrams:
    """Counts of (token before, token), END standing before a document's first."""

    def __init__(self) -> None:
        self.total, self._held, self._size = np.zeros(VOCAB * VOCAB, np.int64), [], 0

    def add(self, docs: list[np.ndarray]) -> None:
        flat = np.concatenate(docs).astype(np.int32)  # each document ends with END, which is what stands before the next
        codes = np.empty(len(flat), np.int32)
        codes[0], codes[1:] = END * VOCAB + flat[0], flat[:-1] * VOCAB + flat[1:]
        self._held.append(codes)
        self._size += len(codes)
        if self._size > 4_000_000:
            self.settle()

    def settle(self) -> np.ndarray:
        if self._held:
            self.total += np.bincount(np.concatenate(self._held), minlength=VOCAB * VOCAB)
        self._held, self._size = [], 0
        return self.total


def tree(counts: np.ndarray, dims: int = 48) -> np.ndarray:
    """An order of the subwords in which those with alike neighbours stand together, down to the last step's size.

    Rows of square roots of neighbour frequencies, before and after, are reduced to their main directions; then the
    subwords are halved again and again along the direction in which each part varies most.
    """
    c = counts.reshape(VOCAB, VOCAB)
    beside = np.concatenate([c, c.T], axis=1).astype(np.float32)
    weight = np.sqrt(beside.sum(axis=1) + 1)
    beside = np.sqrt(beside / np.maximum(beside.sum(axis=1, keepdims=True), 1)) * np.sqrt(weight / weight.sum())[:, None]
    main = np.random.Generator(np.random.PCG64(5)).standard_normal((2 * VOCAB, dims)).astype(np.float32)
    for _ in range(4):
        main = np.linalg.qr(beside.T @ (beside @ main))[0]
    spots = (beside @ main).astype(np.float64) / np.sqrt(weight / weight.sum())[:, None]
    out, size = np.arange(VOCAB), VOCAB
    while size > STEPS[-1]:
        for i in range(0, VOCAB, size):
            part = out[i : i + size]
            share = weight[part] / weight[part].sum()
            x = spots[part] - share @ spots[part]
            along = np.linalg.eigh((x * share[:, None]).T @ x)[1][:, -1]
            out[i : i + size] = part[np.argsort(x @ along, kind="stable")]
        size //= 2
    return out


def tables(counts: np.ndarray) -> tuple[np.ndarray, ...]:
    """Natural logarithms of smoothed P(branch | token before), P(branch, twig | ...) and P(token | ...), a row for
    each choice to be made; and each subword's place in the tree, VOCAB keeping its own."""
    order = tree(counts)
    c = counts.reshape(VOCAB, VOCAB)
    single = ((c.sum(axis=0) + 0.5) / (c.sum() + 0.5 * VOCAB))[order]
    p = np.empty((VOCAB, VOCAB), np.float32)
    for i in range(VOCAB):
        p[i] = (c[i, order] + 20 * single) / (c[i].sum() + 20)
    twigs = p.reshape(VOCAB, -1, STEPS[2]).sum(axis=2)
    branches = twigs.reshape(VOCAB, -1, STEPS[1]).sum(axis=2)
    place = np.full(VOCAB + 1, VOCAB, np.int32)
    place[order] = np.arange(VOCAB)
    return np.log(branches), np.log(twigs).reshape(-1, STEPS[1]), np.log(p, out=p).reshape(-1, STEPS[2]), place


def fresh_weights(seed: int = 7) -> dict[str, np.ndarray]:
    rng = np.random.Generator(np.random.PCG64(seed))
    w = {k: (rng.standard_normal(s) * (0.3 if k in ("token", "place") else WIDTH**-0.5)).astype(np.float32) for k, s in SHAPES.items()}
    return w | {"choice": np.zeros(SHAPES["choice"], np.float32)}


def _softmax(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Exponentials and their sums over the last axis. Logits are small as a rule; only where they overflow or vanish
    is the maximum taken out first."""
    sums = lambda e: (e.reshape(-1, e.shape[-1]) @ np.ones(e.shape[-1], e.dtype)).reshape(*e.shape[:-1], 1)
    with np.errstate(over="ignore", invalid="ignore"):
        e = np.exp(x)
        total = sums(e)
    if total.size and not (total.min() > 1e-30 and total.max() < np.inf):
        np.exp(x - x.max(axis=-1, keepdims=True), out=e)
        total = sums(e)
    return e, total


def fold(w: dict) -> tuple:
    """What a forward pass multiplies. Queries meet keys by one matrix, x (q k') x', and a mean of values leaves by one,
    (a x) (v out), so neither keys nor values are made for each place."""
    both = (w["q"] * np.float32(WIDTH**-0.5)) @ w["k"].T
    return w["token"], w["place"], both, w["v"] @ w["out"], *(np.ascontiguousarray(w["choice"][:, a:b]) for a, b in zip(EDGES, EDGES[1:]))


def _attended(f: tuple, table: tuple, inputs: np.ndarray, wanted: np.ndarray) -> tuple:
    """One forward pass: what attention saw and gave, and for each step its exponentials, their sums, and where in them
    the wanted choice stands."""
    token, place, both, leave, *choice = f
    x = token.take(inputs, axis=0)
    x += place
    last = x[:, CONTEXT - STRIDE :].reshape(-1, WIDTH)
    across = np.ascontiguousarray(x.transpose(0, 2, 1))
    q = (last @ both).reshape(-1, STRIDE, WIDTH)
    a = q @ across
    a += MASK
    a, total = _softmax(a)
    a /= total
    c = (a @ x).reshape(-1, WIDTH)
    h = c @ leave
    h += last
    before, t = inputs[:, CONTEXT - STRIDE :].ravel(), table[3].take(wanted.ravel())
    real = t < VOCAB
    t = t * real
    steps, n = [], np.arange(len(t))
    for part, of, row, pick in zip(choice, table, (before, before * 16 + (t >> 7), before * 256 + (t >> 3)), (t >> 7, t >> 3 & 15, t & 7)):
        logits = h @ part
        logits += of.take(row, axis=0)
        steps.append((*_softmax(logits), n * part.shape[1] + pick))
    return x, across, last, q, a, c, h, real, steps


def _chances(real: np.ndarray, steps: list) -> np.ndarray:
    p = [np.log(np.maximum(e.reshape(-1).take(at), 1e-37) / total[:, 0]) for e, total, at in steps]
    return np.where(real, sum(p), 0)


def forward(w: dict, table: tuple, inputs: np.ndarray, wanted: np.ndarray):
    """Natural log probability of each wanted token (0 where there is none), and what the gradient needs."""
    kept = _attended(fold(w), table, inputs, wanted)
    return _chances(*kept[-2:]), kept


def folded(f: tuple, table: tuple, inputs: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """The scores of forward(), from fold()."""
    return _chances(*_attended(f, table, inputs, wanted)[-2:])


def gradient(w: dict, f: tuple, inputs: np.ndarray, kept: tuple) -> dict[str, np.ndarray]:
    """Of the mean negative log probability; f: fold(w), which `kept` comes from."""
    x, across, last, q, a, c, h, real, steps = kept
    n, scale = len(inputs), np.float32(1 / max(1, real.sum()))
    _, _, both, leave, *choice = f
    each, dh, of_choice = real * scale, None, []
    for (d, sums, at), part in zip(steps, choice):
        d *= each[:, None] / sums
        d.reshape(-1)[at] -= each
        back = d @ np.ascontiguousarray(part.T)  # such products are faster than with a turned view
        dh = back if dh is None else np.add(dh, back, out=dh)
        of_choice.append(h.T @ d)
    of_leave, dc = c.T @ dh, dh @ np.ascontiguousarray(leave.T)
    of_weights = dc.reshape(n, STRIDE, WIDTH) @ across
    of_weights *= a
    mean = (dc * c) @ np.ones((WIDTH, WIDTH), np.float32)  # of a query's slopes under its attention, in each column
    dq = (of_weights @ x).reshape(-1, WIDTH)
    dq -= mean * c
    mean *= q.reshape(-1, WIDTH)
    dc -= mean
    dx = a.transpose(0, 2, 1) @ dc.reshape(n, STRIDE, WIDTH)
    dx += of_weights.transpose(0, 2, 1) @ q
    of_both = last.T @ dq * np.float32(WIDTH**-0.5)
    dh += dq @ np.ascontiguousarray(both.T)
    dx[:, CONTEXT - STRIDE :] += dh.reshape(n, STRIDE, WIDTH)
    return {
        "token": _summed(inputs, dx), "place": (np.ones(n, np.float32) @ dx.reshape(n, -1)).reshape(CONTEXT, WIDTH), "q": of_both @ w["k"], "k": of_both.T @ w["q"], "v": of_leave @ w["out"].T,
        "out": w["v"].T @ of_leave, "choice": np.concatenate(of_choice, axis=1),
    }


def _summed(inputs: np.ndarray, dx: np.ndarray) -> np.ndarray:
    """The sum of each subword's rows."""
    token = np.zeros(PAIRS.size, np.complex64)  # two columns are added at once
    np.add.at(token, PAIRS.take(inputs.ravel(), axis=0).ravel(), dx.view(np.complex64).ravel())
    return token.view(np.float32).reshape(SHAPES["token"])


def train(w: dict, table: tuple, inputs: np.ndarray, wanted: np.ndarray, rate: float, batch: int = 128) -> dict[str, np.ndarray]:
    """One pass of Adam over the windows in their order."""
    flat = np.concatenate([w[k].ravel() for k in SHAPES])  # one array, so that a step takes few calls
    edges = np.cumsum([0, *(w[k].size for k in SHAPES)])
    w = {k: flat[a:b].reshape(s) for (k, s), a, b in zip(SHAPES.items(), edges, edges[1:])}
    first, second = np.zeros_like(flat), np.zeros_like(flat)
    for step, i in enumerate(range(0, len(inputs), batch), 1):
        part, f = inputs[i : i + batch], fold(w)
        d = gradient(w, f, part, _attended(f, table, part, wanted[i : i + batch]))
        g = np.concatenate([d[k].ravel() for k in SHAPES])
        g *= 0.1
        first *= 0.9
        first += g
        g *= g  # a hundredth of the slope's square
        second *= 0.99
        second += g
        # the means' first steps count less: both are divided by what their weights add up to
        least = math.sqrt(1 - 0.99**step)
        np.sqrt(second, out=g)
        g += 1e-6 * least
        np.divide(first, g, out=g)
        g *= rate * least / (1 - 0.9**step)
        flat -= g
    return w


def score(w: dict, table: tuple, docs: list[np.ndarray], at_once: int = 192) -> np.ndarray:
    """log10 probability of each document, every token scored once."""
    inputs, wanted, owner, _ = windows(docs)
    total, f = np.zeros(len(docs)), fold(w)
    for i in range(0, len(inputs), at_once):
        # kept until the next is there: its memory would go back to the system each time
        kept = _attended(f, table, inputs[i : i + at_once], wanted[i : i + at_once])
        total += np.bincount(owner[i : i + at_once], _chances(*kept[-2:]).reshape(-1, STRIDE).sum(axis=1, dtype=np.float64), len(docs))
    return total / np.log(10)


def pack(a: np.ndarray, level: int = 1) -> bytes:
    return zlib.compress(a.tobytes(), level)
