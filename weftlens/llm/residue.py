"""Template residue, filler and error-page text (problem 10).

Hashed character n-gram models are fitted for filler, notices, instructions
and natural prose. The models of residue come from labelled examples and are
laid over the model of natural prose: where an example's context was never
seen they say what natural prose says, and the likelihood ratio is 0. Each
text is cut into windows (sentences, lines, values after a colon, bracketed
spans and the best-scoring segments inside long lines); windows whose ratio is
sure enough are residue, unless they stand in quotation marks. A document's
coverage is its share of residue.

The models are fitted over all documents. Sentences that are made of the
examples' n-grams become examples themselves, so that the wording of a corpus
is learnt, and aren't natural prose: a model fitted on them would foretell
them. All other sentences are.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftlens.session import default_parallelism

from . import residue_seeds as seeds

ORDER = 5
#: Bits of a table place, for natural prose and for residue.
SLOT_BITS, SEED_BITS = 21, 18
#: Share of the natural model's probability that all characters have alike, and the number of characters.
UNSEEN, ALPHABET = 0.02, 4000
#: Weight of natural prose inside a residue model, in characters seen.
STRENGTH = 0.3
#: Most that one character speaks for residue and against it; a character of a dense script stands for more.
GAIN, DENSE_GAIN = 1.0, 2.0
#: What is asked for in an instruction may be anything: it speaks less against it.
LOSS = {"notice": -3.0, "filler": -3.0, "sample": -3.0, "instruction": -1.0}
KINDS = tuple(LOSS)
#: Kinds of sentences: error and script notices, mock Latin and key strokes, and prose that only fills.
SENTENCE_KINDS = KINDS[:3]
#: Share of its characters that end n-grams of the examples from which a sentence isn't natural prose.
CLAIMED = {"notice": 0.5, "filler": 0.2, "sample": 0.6, "instruction": 0.7}
#: The same share of a bracketed span, from which it is an instruction and no prose.
CLAIMED_SPAN = 0.25
#: The same shares, from which a sentence or span is an example itself when the models are fitted again.
LEARNT = {"notice": 0.65, "filler": 0.25, "sample": 0.7, "instruction": 0.45}
#: Mean log-likelihood ratio of a character from which a marked name is one of code.
CODE_NAME = -2.5
#: Log-likelihood ratio from which a bracketed span is an instruction: its brackets say something already.
SURE_SPAN = 3.0
#: n-grams of the examples that such a sentence has at least; one of a dense script counts twice.
LEAST_GRAMS = {"notice": 6, "filler": 15, "sample": 8, "instruction": 0}
#: Letters that a window of sentences has at least.
LEAST_LETTERS = 6
#: Table places in one row of summed counts.
ROW = 1 << 16
_MULT = np.uint64(0x9E3779B97F4A7C15)
_STOP = re.compile(r"[.!?。！？]+[ \t]*|\n\s*")
#: Every span from an opening mark to its closing mark, whatever stands between; a further opening mark starts anew.
_MARKED = re.compile(
    "|".join(
        [rf"(?<!_)__(?=[^\s_])(?:(?!__).)+(?<=[^\s_])__(?!_)" if a == "__" else f"{re.escape(a)}(?:(?!{re.escape(a)}|{re.escape(b)}).)+{re.escape(b)}" for a, b in sorted(seeds.PLACEHOLDER_MARKS, key=lambda m: -len(m[0]))]
        + [r"(?<![\w%])%[^\W\d]\w*%(?![\w%])", r"(?<![\w$])\$[^\W\d]\w+\b(?!\$)"]
    ),
    re.DOTALL,
)
_MARKS = re.compile(r"[{<$%\[]|@@|__")
_SPAN = re.compile(
    r"\[[^\[\]]{2,}\]|<[^<>]{3,}>|\([^()]{3,}\)|（[^（）]{2,}）|【[^【】]{2,}】|＜[^＜＞]{2,}＞|_{4,}(?: ?\([^()]{3,}\))?|\bTODO: ?[^\n,.;]{3,}|\b[XDMTYJ]{2}[/.-][XMDT]{2}[/.-](?:\d{2}XX|[XYJ]{4})\b|(?:\d{2}XX|XXXX) ?[年년] ?X{1,2} ?[月월] ?X{1,2} ?[日일]"
)
_VALUE = re.compile(r"^[^\n:：]{1,40}[:：][ \t]*([^\n]+)$", re.MULTILINE)
_BLANKS = re.compile(r"\s+(?:> ?)*")


def encode_all(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Code points of the texts after one another, and where the scores of each begin and end.

    Letters in lower case, digits alike, blanks and line breaks one space, so
    that wrapped and shouted text reads as the same text. Each text has a start
    of four marks of its own.
    """
    start = "\x00\x00\x00\x01"
    if any("\x01" in t for t in texts):
        texts = [t.replace("\x01", "\x02") for t in texts]
    joined = _BLANKS.sub(" ", start + start.join(texts)).lower() if texts else ""
    codes = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32).copy()
    codes[(codes > 48) & (codes < 58)] = 48
    marks = np.flatnonzero(codes == 1)
    begin = marks - (ORDER - 2)
    return codes, begin, np.concatenate([begin[1:] - (ORDER - 1), [len(codes) - (ORDER - 1)]]) if len(begin) else begin


def slots(codes: np.ndarray) -> list[np.ndarray]:
    """Table places of the n-grams that end at each character from the fifth on, for orders 1 to 5, in tables of 2^SLOT_BITS; smaller tables take their first bits."""
    shift, h, out, n = np.uint64(64 - SLOT_BITS), np.zeros(max(0, len(codes) - ORDER + 1), np.uint64), [], len(codes)
    for k in range(ORDER):
        part = codes[ORDER - 1 - k : n - k].astype(np.uint64) + np.uint64(1)
        h = h + part * (_MULT ** np.uint64(k + 1) | np.uint64(1))
        out.append(((h * _MULT) >> shift).astype(np.int32))
    return out


def _before(at: np.ndarray) -> np.ndarray:
    return np.concatenate([at[:1], at[:-1]])


def _sums(values: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0.0], np.cumsum(values, dtype=np.float64)])
    return total[end] - total[begin]


class NgramModel:
    """Counts of character n-grams of orders 1 to 5 in hash tables of 2^bits; those of orders 2 and 4 as contexts of the next character."""

    def __init__(self, bits: int):
        self.bits = bits
        self.tables = [np.zeros(1 << bits) for _ in range(ORDER)]
        self.total = 0.0

    def __getstate__(self) -> dict:
        return self.__dict__ | {"tables": [zlib.compress(t.astype(np.float32).tobytes(), 1) for t in self.tables]}

    def __setstate__(self, state: dict) -> None:
        self.__dict__ |= state | {"tables": [np.frombuffer(zlib.decompress(t), np.float32) for t in state["tables"]]}

    def add(self, texts: list[str]) -> None:
        """Counts the texts, each from its own start."""
        for part in _portions(texts):
            codes, begin, end = encode_all(texts[part])
            own = _inside(np.ones(len(begin), bool), begin, end, max(0, len(codes) - ORDER + 1))
            followed = own.copy()
            followed[end[end > begin] - 1] = False  # nothing comes after the last character: there it is no context
            for k, (table, at) in enumerate(zip(self.tables, slots(codes))):
                table += np.bincount(at[followed if k in (1, 3) else own] >> (SLOT_BITS - self.bits), minlength=len(table))
            self.total += float(own.sum())

    def prob(self, slots: list[np.ndarray], strength: float = 1.0, where: np.ndarray | slice = slice(None)) -> np.ndarray:
        """Probability of each character, or of those at ``where``, after the four before it, interpolated over orders 5, 3 and 1."""
        place = lambda x: x[where] >> (SLOT_BITS - self.bits)
        p = self.tables[0][place(slots[0])] / max(self.total, 1.0)
        for k in (2, 4):
            context = self.tables[k - 1][place(_before(slots[k - 1]))]
            p = (np.minimum(self.tables[k][place(slots[k])], context) + strength * p) / (context + strength)
        return (1 - UNSEEN) * p + UNSEEN / ALPHABET


def sentences(text: str) -> list[tuple[int, int]]:
    """Start and end of each sentence or line, without the blanks at its ends.

    A line that goes on in lower case is no end: wrapped text stays whole.
    """
    out, a = [], 0
    stops = [m.end() for m in _STOP.finditer(text) if "\n" not in m.group() or not text[m.end() : m.end() + 3].lstrip("> ")[:1].islower()]
    for b in [*stops, len(text)]:
        part = text[a:b]
        left = a + len(part) - len(part.lstrip())
        right = left + len(part.strip())
        if right > left:
            out.append((left, right))
        a = b
    return out


def _quoted(text: str, a: int, b: int) -> bool:
    return a > 0 and b < len(text) and text[a - 1] in seeds.QUOTES_OPEN and text[b] in seeds.QUOTES_CLOSE


class ResidueModels:
    """Models of filler, notices, instructions, placeholders and natural prose."""

    def __init__(self, natural: list[str], bits: int = SLOT_BITS):
        self.residue = {kind: NgramModel(SEED_BITS) for kind in KINDS}
        self.residue["notice"].add(seeds.NOTICES + seeds.STATUS_LINES)
        latin = sorted({w for t in seeds.LATIN for w in re.findall(r"\w+", t.lower())})
        orders = [" ".join(latin[(i * step) % len(latin)] for i in range(len(latin))) for step in (1, 5, 7, 11, 13, 17, 19)]
        self.residue["filler"].add(seeds.LATIN * 3 + orders + [" ".join([w] * 8) for w in seeds.FILLER_KEYS])
        self.residue["sample"].add(seeds.FILLERS)
        self.residue["instruction"].add(seeds.INSTRUCTIONS + [x[1:-1] for x in seeds.INSTRUCTIONS if x[0] == "["])
        self.shapes, self.data, self.names, self.code = (NgramModel(SEED_BITS - 2) for _ in range(4))
        self.shapes.add([f"{a}{pad}{_shape(inside)}{pad}{b}" for a, b in seeds.PLACEHOLDER_MARKS for inside in seeds.PLACEHOLDER_INSIDES for pad in ("", " ")] + ["%a%", "$a"])
        self.data.add([_shape(x) for x in seeds.MARKED_DATA])
        self.names.add([f"{a}{pad}{form}{pad}{b}" for a, b in seeds.PLACEHOLDER_MARKS for name in seeds.TEMPLATE_NAMES for form in (name, name.upper()) for pad in ("", " ")])
        self.code.add(seeds.CODE_NAMES * 8)
        self.known_spans: dict[str, float] = {}
        self.natural = NgramModel(bits)
        self.refit([{kind: self._counts(x) for kind, x in self.examples(natural).items()}])
        self.natural.add(self.prose(natural))

    @staticmethod
    def _counts(texts: list[str]) -> list[np.ndarray]:
        model = NgramModel(SEED_BITS)
        model.add(texts)
        return model.tables

    def refit(self, found: list[dict[str, list[np.ndarray]]]) -> None:
        """Adds the counts of examples found in the documents to those of the labelled ones."""
        for counts in found:
            for kind, tables in counts.items():
                for table, more in zip(self.residue[kind].tables, tables):
                    table += more

    def placeholders(self, text: str) -> list[tuple[int, int, float]]:
        """Start, end and log-likelihood ratio of the marked spans that are more like placeholders than like data and code.

        Their shape counts, whatever the value is called, and their own
        characters where these are a name of code by the examples.
        """
        out, at = [], 0
        if not _MARKS.search(text):
            return out
        while m := _MARKED.search(text, at):
            span = m.group()
            if (ratio := self.known_spans.get(span)) is None:
                ratio = self._compare(self.shapes, self.data, _shape(span))
                name = self._compare(self.names, self.code, span)
                ratio += name if name < CODE_NAME * len(span) else 0.0
                if len(span) <= 80 and len(self.known_spans) < 100_000:
                    self.known_spans[span] = ratio
            if ratio > 0:
                out.append((m.start(), m.end(), ratio))
            at = m.end() if ratio > 0 else m.start() + 1
        return out

    @staticmethod
    def _compare(one: NgramModel, other: NgramModel, text: str) -> float:
        """Log-likelihood ratio of two models of the same smoothing: what neither has seen speaks for none."""
        codes, begin, end = encode_all([text])
        at = slots(codes)
        return float(_sums(np.log(one.prob(at, 0.2)) - np.log(other.prob(at, 0.2)), begin, end)[0])

    def bare(self, text: str) -> str:
        """The text with blanks for its placeholders."""
        for a, b, _ in self.placeholders(text):
            text = text[:a] + " " * (b - a) + text[b:]
        return text

    def _dense(self, codes: np.ndarray) -> np.ndarray:
        """Whether each scored character is of a script whose characters stand for syllables or words."""
        return codes[ORDER - 1 :] >= 0x1100

    def shares(self, texts: list[str]) -> dict[str, np.ndarray]:
        """Share of the characters of each text that end n-grams of each kind's examples: of order 5, of order 3 in dense scripts; 0 where they are too few."""
        parts = [self._shares(texts[part]) for part in _portions(texts)]
        return {kind: np.concatenate([np.zeros(0), *(p[kind] for p in parts)]) for kind in KINDS}

    def _shares(self, texts: list[str]) -> dict[str, np.ndarray]:
        codes, begin, end = encode_all(texts)
        at = [x >> (SLOT_BITS - SEED_BITS) for x in slots(codes)]
        dense = self._dense(codes)
        hit = {kind: np.where(dense, model.tables[2][at[2]], model.tables[4][at[4]]) > 0 for kind, model in self.residue.items()}
        return {kind: np.where(_sums(h * np.where(dense, 2, 1), begin, end) >= LEAST_GRAMS[kind], _sums(h, begin, end), 0) / np.maximum(1, end - begin) for kind, h in hit.items()}

    def examples(self, texts: list[str]) -> dict[str, list[str]]:
        """Sentences and bracketed spans that are so much made of the examples that they are further ones, by kind."""
        bare = [self.bare(t) for t in texts]
        out: dict[str, list[str]] = {kind: [] for kind in KINDS}
        for kinds, parts in ((("instruction",), [m.group() for t in bare for m in _SPAN.finditer(t) if _wordy(m.group())]), (SENTENCE_KINDS, [line for t in bare for a, b in sentences(t) for line in t[a:b].splitlines()])):
            if parts:
                share = self.shares(parts)
                best = np.argmax([share[kind] for kind in kinds], 0)
                for n, kind in enumerate(kinds):
                    out[kind] += [parts[k] for k in np.flatnonzero((best == n) & (share[kind] >= LEARNT[kind]))]
        return out

    def prose(self, texts: list[str]) -> list[str]:
        """What counts as natural prose: the sentences that aren't made of the examples, without lines that are, blanks for their placeholders and instructions."""
        out = []
        for text in texts:
            bare = self.bare(text)
            spans = [m for m in _SPAN.finditer(bare) if _wordy(m.group())]
            if spans:
                share = self.shares([m.group() for m in spans])["instruction"]
                for m, s in zip(spans, share):
                    if s >= CLAIMED_SPAN:
                        bare = bare[: m.start()] + " " * (m.end() - m.start()) + bare[m.end() :]
            out += [bare[a:b] for a, b in sentences(bare)]
        # A notice may be one line of what reads as a wrapped sentence.
        wrapped = [k for k, part in enumerate(out) if "\n" in part]
        lines = [(k, line) for k in wrapped for line in out[k].splitlines()]
        kept: dict[int, list[str]] = {k: [] for k in wrapped}
        for (k, line), claimed in zip(lines, self._claimed([line for _, line in lines])):
            if not claimed:
                kept[k].append(line)
        for k in wrapped:
            out[k] = "\n".join(kept[k])
        return [p for p, claimed in zip(out, self._claimed(out)) if not claimed and p]

    def _claimed(self, parts: list[str]) -> np.ndarray:
        """Which parts are made of the examples' n-grams."""
        claimed = np.zeros(len(parts), bool)
        for kind, share in self.shares(parts).items():
            claimed |= share >= CLAIMED[kind]
        return claimed

    def gains(self, texts: list[str], sure: float) -> tuple[dict[str, np.ndarray], np.ndarray, np.ndarray, np.ndarray]:
        """Log-likelihood ratio of each character by kind, where the texts begin and end, and which may hold residue at all.

        Natural prose is only asked about texts whose n-grams of examples, taken
        at the most that they can speak for, are enough to be sure of anything.
        """
        codes, begin, end = encode_all(texts)
        at = slots(codes)
        small = [x >> (SLOT_BITS - SEED_BITS) for x in at]
        dense = self._dense(codes)
        most = np.where(dense, DENSE_GAIN, GAIN)
        found, bound = {}, np.zeros(len(texts))
        for kind, model in self.residue.items():
            gram = np.where(dense, model.tables[2][small[2]], model.tables[4][small[4]])
            context = np.where(dense, model.tables[1][_before(small[1])], model.tables[3][_before(small[3])])
            gram = np.minimum(gram, context)
            # What a character speaks at most: nothing where its context is new, against residue where it differs from all examples.
            top = np.where(gram > 0, most, np.where(context > 0, np.maximum(LOSS[kind], np.log(STRENGTH / (context + STRENGTH))), 0.0))
            found[kind] = (gram, context)
            bound = np.maximum(bound, _best_rises(top, begin, end))
        open_ = bound >= min(SURE_SPAN, sure)
        asked = np.flatnonzero(_inside(open_, begin, end, len(dense)))
        natural = np.ones(len(dense))
        natural[asked] = self.natural.prob(at, where=asked)
        out = {}
        for kind, (gram, context) in found.items():
            gain = np.log((gram + STRENGTH * natural) / (context + STRENGTH)) - np.log(natural)
            out[kind] = np.where(context > 0, np.clip(gain, LOSS[kind], most), 0.0)
        return out, begin, end, open_

    def _scores(self, texts: list[str], sure: float) -> tuple[np.ndarray, dict[str, np.ndarray], list[tuple[int, str, list]]]:
        """Which texts may hold residue, their ratios by kind, and the segments inside them that are sure enough.

        A segment may start and end at any character: its ratio must be above
        ``sure`` by twice the logarithm of the text's length.
        """
        gains, begin, end, open_ = self.gains(texts, sure)
        need, segments = sure + 2 * np.log(np.maximum(end - begin, 1)), []
        for kind in SENTENCE_KINDS:
            # At no place does the sum rise by more than this: most lines end here.
            for k in np.flatnonzero(open_ & (_best_rises(gains[kind], begin, end) >= need)):
                segments.append((int(k), kind, _runs(gains[kind][begin[k] : end[k]].tolist(), need[k])))
        return open_, {kind: _sums(g, begin, end) for kind, g in gains.items()}, segments

    def windows(self, texts: list[str], sure: float) -> list[list[tuple[str, int, int, float]]]:
        """(kind, start, end, log-likelihood ratio) of the residue in each text, in order."""
        out: list[list[tuple[str, int, int, float]]] = [[] for _ in texts]
        bare = []
        for i, t in enumerate(texts):
            marks = self.placeholders(t)
            out[i] += [("placeholder", a, b, ratio) for a, b, ratio in marks if not _quoted(t, a, b)]
            for a, b, _ in marks:
                t = t[:a] + " " * (b - a) + t[b:]
            bare.append(t)
        spans = [(i, m.start(), m.end()) for i, t in enumerate(bare) for m in _SPAN.finditer(t) if _wordy(m.group())]
        parts = [(i, a, b) for i, t in enumerate(bare) for a, b in sentences(t)]
        seen = set(parts)
        values = [(i, *m.span(1)) for i, t in enumerate(bare) for m in _VALUE.finditer(t) if (i, *m.span(1)) not in seen]
        every = spans + parts + values
        if not every:
            return [sorted(w, key=lambda x: (x[1], x[2])) for w in out]
        # A long text is many parts: they are scored as many at once as make a million characters.
        strings = [bare[i][a:b] for i, a, b in every]
        scored = [self._scores(strings[part], sure) for part in _portions(strings)]
        open_ = np.concatenate([s[0] for s in scored])
        total = {kind: np.concatenate([s[1][kind] for s in scored]) for kind in KINDS}
        segments = [(k + at.start, kind, runs) for s, at in zip(scored, _portions(strings)) for k, kind, runs in s[2]]

        def add(i: int, kind: str, a: int, b: int, ratio: float) -> None:
            if not _quoted(texts[i], a, b) and not any(x[1] < b and a < x[2] for x in out[i]):
                out[i].append((kind, int(a), int(b), float(ratio)))

        def letters(i: int, a: int, b: int) -> bool:
            return sum(map(str.isalpha, bare[i][a:b])) >= LEAST_LETTERS

        for k, (i, a, b) in enumerate(spans):
            if total["instruction"][k] >= SURE_SPAN:
                add(i, "instruction", a, b, total["instruction"][k])
        for k in range(len(spans), len(every)):
            i, a, b = every[k]
            if open_[k] and total["instruction"][k] >= sure and total["instruction"][k] > max(total[x][k] for x in SENTENCE_KINDS) and letters(i, a, b):
                add(i, "instruction", a, b, total["instruction"][k])
        # Neighbouring sentences in favour of residue are one window.
        merged: list[list] = []
        last = None
        for k in range(len(spans), len(spans) + len(parts)):
            i, a, b = every[k]
            kind = max(SENTENCE_KINDS, key=lambda x: total[x][k])
            ratio = total[kind][k]
            if ratio > 0 and last == i:
                merged[-1][3], merged[-1][4] = b, merged[-1][4] + ratio
            elif ratio > 0:
                merged.append([i, kind, a, b, ratio])
            last = i if ratio > 0 else None
        for i, kind, a, b, ratio in merged:
            if ratio >= sure and letters(i, a, b):
                add(i, kind, a, b, ratio)
        for k, kind, runs in sorted(segments, key=lambda x: (SENTENCE_KINDS.index(x[1]), x[0])):
            if len(spans) <= k < len(spans) + len(parts):
                i, first, last = every[k]
                back = _places(bare[i][first:last])
                for a, b, ratio in runs:
                    a, b = first + back[a], first + back[b - 1] + 1
                    if letters(i, a, b):
                        add(i, kind, a, b, ratio)
        return [sorted(w, key=lambda x: (x[1], x[2])) for w in out]


def _inside(chosen: np.ndarray, begin: np.ndarray, end: np.ndarray, size: int) -> np.ndarray:
    """Whether each place lies in a chosen part."""
    edges = np.zeros(size + 1, np.int32)
    np.add.at(edges, begin[chosen], 1)
    np.add.at(edges, end[chosen], -1)
    return np.cumsum(edges[:-1]) > 0


def _best_rises(gain: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """The best sum of neighbouring values inside each part.

    Parts are set so far below one another that the least sum so far is always
    the part's own.
    """
    path = np.concatenate([[0.0], np.cumsum(np.where(_inside(np.ones(len(begin), bool), begin, end, len(gain)), gain, 0.0))])
    part = np.zeros(len(path))
    np.add.at(part, begin, 1.0)
    path -= np.cumsum(part) * (2.0 * np.abs(path).max() + 1.0)
    return np.maximum.reduceat(path - np.minimum.accumulate(path), begin) if len(begin) else np.zeros(0)


def _runs(gain: list[float], need: float) -> list[tuple[int, int, float]]:
    """Start, end and sum of the runs whose sum reaches ``need``, each from where the running sum leaves 0 to its peak; it ends ``need`` below the peak."""
    out, total, peak, start, end = [], 0.0, 0.0, 0, 0
    for k, g in enumerate([*gain, -float("inf")]):
        total += g
        if total > peak:
            peak, end = total, k + 1
        if total <= 0 or total < peak - need:
            if peak >= need:
                out.append((start, end, peak))
            total, peak, start, end = 0.0, 0.0, k + 1, k + 1
    return out


def _places(line: str) -> list[int]:
    """The place in the line of each character of its encoded form."""
    out: list[int] = []
    at = 0
    for m in [*_BLANKS.finditer(line), None]:
        for k in range(at, m.start() if m else len(line)):
            out += [k] * len(line[k].lower())
        if m:
            out.append(m.start())
            at = m.end()
    return out


def _wordy(span: str) -> bool:
    """Whether a bracketed span holds more than numbers and codes: two letters in a row, or a blank to fill."""
    return span.startswith("____") or bool(re.search(r"[^\W\d_]{2}", re.sub(r"\b(?=\w*\d)[0-9a-fA-F]+\b", "", span)))


def _shape(span: str) -> str:
    """Whatever the value is called: letters and digits of a name read as one letter, numbers as one digit, blanks as one blank."""
    return re.sub(r"\s+", " ", re.sub(r"[^\W\d_][\w.\-]*", "a", re.sub(r"\b\d[\d.]*\b", "0", span)) if not span.startswith("__") else f"__{_shape(' ' + span[2:-2])[1:]}__")


def _portions(texts: list[str]) -> Iterator[slice]:
    """As many texts at once as make a million characters, one at least."""
    at = 0
    while at < len(texts):
        size, to = 0, at
        while to < len(texts) and (to == at or size + len(texts[to]) <= 1_000_000):
            size, to = size + len(texts[to]), to + 1
        yield slice(at, to)
        at = to


def _table_sums(documents: DataFrame, models: ResidueModels, counts: Callable[[ResidueModels, list[str]], list[np.ndarray]]) -> list[np.ndarray]:
    """Sums over all documents (text) of the tables that ``counts`` gives for some of them.

    Tables have a fixed size: each of as many tasks as there are cores sends
    one set of them, whatever the corpus; they are summed in Spark, in two
    steps where there are very many cores.
    """
    shared = documents.sparkSession.sparkContext.broadcast(models)
    sizes = [len(t) for t in counts(models, [])]

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tables = [np.zeros(n) for n in sizes]
        for batch in batches:
            texts = batch["text"].tolist()
            for part in _portions(texts):
                for table, more in zip(tables, counts(shared.value, texts[part])):
                    table += more
        for k, table in enumerate(tables):
            yield pd.DataFrame([(k, i, zlib.compress(table[i : i + ROW].tobytes(), 1)) for i in range(0, len(table), ROW)], columns=["k", "at", "counts"])

    def added(rows: pd.DataFrame) -> pd.DataFrame:
        total = sum(np.frombuffer(zlib.decompress(c)) for c in rows["counts"])
        return pd.DataFrame([(rows["k"].iat[0], rows["at"].iat[0], zlib.compress(total.tobytes(), 1))], columns=["k", "at", "counts"])

    schema, tasks = "k int, at int, counts binary", default_parallelism(documents.sparkSession)
    rows = documents.select("text").filter("text is not null and trim(text) <> ''").coalesce(tasks).mapInPandas(count, schema)
    if tasks > 64:
        rows = rows.withColumn("part", F.spark_partition_id() % 64).groupBy("k", "at", "part").applyInPandas(lambda rows: added(rows), schema)
    out = [np.zeros(n) for n in sizes]
    for r in rows.groupBy("k", "at").applyInPandas(added, schema).collect():
        found = np.frombuffer(zlib.decompress(r["counts"]))
        out[r["k"]][r["at"] : r["at"] + len(found)] = found
    shared.destroy()
    return out


def _example_counts(models: ResidueModels, texts: list[str]) -> list[np.ndarray]:
    found = models.examples(texts)
    return [table for kind in KINDS for table in models._counts(found[kind])]


def _prose_counts(models: ResidueModels, texts: list[str]) -> list[np.ndarray]:
    model = NgramModel(models.natural.bits)
    model.add(models.prose(texts))
    return [*model.tables, np.array([model.total])]


def fit_models(documents: DataFrame) -> ResidueModels:
    """Models fitted over all documents (text), whatever their length.

    The first count adds the sentences and spans that are made of the labelled
    examples to them; the second counts natural prose, without what is made of
    the examples then.
    """
    models = ResidueModels([])
    tables = _table_sums(documents, models, _example_counts)
    models.refit([{kind: tables[k * ORDER : (k + 1) * ORDER] for k, kind in enumerate(KINDS)}])
    *tables, total = _table_sums(documents, models, _prose_counts)
    for table, more in zip(models.natural.tables, tables):
        table += more
    models.natural.total += float(total[0])
    return models


def find_residue(documents: DataFrame, sure: float = 8.0, models: ResidueModels | None = None) -> DataFrame:
    """(doc_id, kind, start, length, ratio, n_chars) of each residue window of documents (doc_id, text).

    Null and blank texts and texts without residue have no row; whole texts are
    read, whatever their length. Repeated rows repeat their windows.
    """
    shared = documents.sparkSession.sparkContext.broadcast(models or fit_models(documents))

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            ids, texts = batch["doc_id"].tolist(), [t if isinstance(t, str) else "" for t in batch["text"]]
            rows = []
            for part in _portions(texts):
                for i, t, found in zip(ids[part], texts[part], shared.value.windows(texts[part], sure)):
                    rows += [(i, kind, a, b - a, ratio, len(t)) for kind, a, b, ratio in found]
            yield pd.DataFrame(rows, columns=["doc_id", "kind", "start", "length", "ratio", "n_chars"])

    return documents.select("doc_id", "text").mapInPandas(scan, "doc_id long, kind string, start int, length int, ratio double, n_chars int")


def residue_documents(documents: DataFrame, sure: float = 8.0, least_coverage: float = 0.0, models: ResidueModels | None = None) -> DataFrame:
    """(doc_id, coverage, kinds) of the documents whose share of residue is above ``least_coverage``: those to exclude."""
    found = find_residue(documents, sure, models)
    # Windows of one document come from one row: overlaps of different kinds count once at most by the cap at 1.
    sums = found.groupBy("doc_id").agg(F.least(F.lit(1.0), F.sum("length") / F.max("n_chars")).alias("coverage"), F.array_sort(F.collect_set("kind")).alias("kinds"))
    return sums.filter(F.col("coverage") > least_coverage)
