"""Personal data: fixed patterns, and a linear-chain conditional random field that adds to them.

Base spans come from four patterns (e-mail addresses, IPv4 addresses, payment cards that pass the
Luhn test, international phone numbers). The field labels tokens (letter runs, digit runs, single
other characters) with O or begin/inside of a kind, from word-shape features of the token and its two
neighbours on either side. It is trained here, by gradient steps on the likelihood of a small labelled table
(``pii_lines``), and decoded by Viterbi in numpy. It finds what the patterns leave: "kim at mail dot org",
"(555) 123-4567", "4111.1111.1111.1111".

Every token of every text is decoded, and the labels are those of the best path through the whole text. A token is *surely
O* if the best of all spans that could lie over it, however long, scores less than O in its place, whatever the labels around.
The best path is O there, so what lies between such tokens is decoded by itself, many stretches at a time, of any length.
The field's spans count only
if they pass the same tests as base spans (digits, Luhn, octets) and overlap no base span.

Defined results: null and empty texts have no spans; offsets are code points; very long texts are
scanned in one linear pass; stretches are decoded in blocks of
bounded size, a longer one alone, in room in proportion to its length; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame

from quiremill.llm import pii_lines
from quiremill.llm._common import sliced

KINDS = ("email", "ip", "card", "phone")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
#: Possessive runs and the look-behind only forbid starts that cannot match; matches are those of the plain pattern.
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGITS = re.compile(r"[0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if k % 2:
            d = d * 2 - 9 * (d > 4)
        total += d
    return total % 10 == 0


def _octets(parts) -> bool:
    return all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in parts)


def _emails(text: str) -> list[tuple[int, int]]:
    out, at, end = [], text.find("@"), 0
    while at >= 0:
        begin = at
        while begin > end and text[begin - 1] in _LOCAL:
            begin -= 1
        if begin < at and (m := _DOMAIN.match(text, at + 1)):
            out.append((begin, m.end()))
            end = m.end()
        elif begin < at:
            # the run before this "@" cannot start a later match; it may still be scanned once from a later "@"
            end = max(end, at + 1)
        at = text.find("@", max(at + 1, end))
    return out


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) by kind as listed, then start."""
    out = []
    if "@" in text:
        out += [("email", a, b) for a, b in _emails(text)]
    if _DIGITS.search(text):
        out += [("ip", *m.span()) for m in _IP.finditer(text) if _octets(m.group().split("."))]
        for m in _CARD.finditer(text):
            if m.end() - m.start() >= 13 and 13 <= len(d := m.group().replace(" ", "").replace("-", "")) <= 19 and luhn(d):
                out.append(("card", *m.span()))
        if "+" in text:
            out += [("phone", *m.span()) for m in _PHONE.finditer(text) if 9 <= sum("0" <= c <= "9" for c in m.group()) <= 15]
    return out


# --- the field -------------------------------------------------------------------------------

#: Tokens of the stretches that are decoded together, stretches of them, tokens that are scored together, and characters of texts that are turned to tokens together.
BLOCK, LANES, SCORED, ROOM = 1 << 19, 4096, 1 << 16, 1 << 20
_HINTS = pii_lines.HINTS
_CLASSES = ["", "lower", "title", "upper", "other", *_HINTS, *(f"d{n}" for n in (1, 2, 3, 4, "5-6", "7-12", "13-19", "20+")), *"@.+-():/=,[]_", "mark"]
_NUMBER = {c: k for k, c in enumerate(_CLASSES)}
_SYMBOLS = 2 * len(_CLASSES)
_LABELS = ["O", *(f"{p}-{k}" for k in KINDS for p in "BI")]
_REACH = (-2, -1, 0, 1, 2)
_NEVER = -1e4
#: What a code point is: white space, of a letter run, of a digit run, a token by itself, or the mark between texts.
_SPACE, _WORD, _DIGIT, _SINGLE, _BETWEEN = range(5)
_MARK = "\ud800"  # no text from a table holds half a surrogate pair
#: A letter run of at most this many ASCII letters can be a hint.
_HINT_LETTERS = max(len(w) for words in _HINTS.values() for w in words)


@lru_cache(maxsize=1)
def _code_points() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each code point its kind, its case (1 lower, 2 upper), and its class as a token."""
    kind, case, own = np.full(0x110000, _SINGLE, np.uint8), np.zeros(0x110000, np.uint8), np.full(0x110000, _NUMBER["mark"], np.uint8)
    for k in range(0x110000):
        c = chr(k)
        if c.isalnum():
            if not c.isdecimal():
                kind[k] = _WORD
                case[k] = 1 if c.islower() else 2 if c.isupper() else 0
        elif c.isspace():
            kind[k] = _SPACE
    kind[ord("0") : ord("9") + 1] = _DIGIT
    for c in _CLASSES:
        if len(c) == 1:
            own[ord(c)] = _NUMBER[c]
    kind[ord(_MARK)] = _BETWEEN
    return kind, case, own


@lru_cache(maxsize=1)
def _hints() -> tuple[np.ndarray, np.ndarray]:
    found = sorted((_key(w), _NUMBER[group]) for group, words in _HINTS.items() for w in words if w.isalpha())
    return np.array([k for k, _ in found]), np.array([n for _, n in found])


def _key(word: str) -> int:
    out = 0
    for c in word:
        out = out * 32 + ord(c) - 96
    return out


_BY_LENGTH = np.array([0] + [_NUMBER[f"d{n}"] for n in (1, 2, 3, 4)] + [_NUMBER["d5-6"]] * 2 + [_NUMBER["d7-12"]] * 6 + [_NUMBER["d13-19"]] * 7 + [_NUMBER["d20+"]])


class Tokens:
    """The tokens of some texts in one row, with two marks before, between and behind: ``symbols`` (word shape, and whether white space comes before; 0 for marks), ``start`` and ``end`` in the row of all characters, and ``first``, where each text begins there."""

    def __init__(self, texts: list[str]):
        codes = np.frombuffer((_MARK * 2 + "".join([t + _MARK * 2 for t in texts])).encode("utf-32-le", "surrogatepass"), np.uint32)
        self.first = np.cumsum([2, *(len(t) + 2 for t in texts)])[:-1]
        kinds, cases, own = _code_points()
        kind = kinds[codes]
        run = (kind == _WORD) | (kind == _DIGIT)
        change = kind[1:] != kind[:-1]
        alone = kind >= _SINGLE
        begin, end = alone.copy(), alone.copy()
        begin[1:] |= run[1:] & change
        end[:-1] |= run[:-1] & change
        self.start, self.end = np.flatnonzero(begin), np.flatnonzero(end) + 1
        first = kind[self.start]
        size = self.end - self.start
        shape = own[codes[self.start]].astype(np.int64)
        digits = first == _DIGIT
        shape[digits] = _BY_LENGTH[np.minimum(size[digits], 20)]
        words = np.flatnonzero(first == _WORD)
        a, z, n = self.start[words], self.end[words], size[words]
        case = cases[codes]
        low, up = (np.concatenate([[0], np.cumsum(case == k, dtype=np.int32)]) for k in (1, 2))
        low, up = low[z] - low[a], up[z] - up[a]
        shape[words] = np.where((up == 0) & (low > 0), _NUMBER["lower"], np.where((low == 0) & (up > 0), _NUMBER["upper"], np.where((up == 1) & (case[a] == 2), _NUMBER["title"], _NUMBER["other"])))
        # letters as digits of base 32, for the few words that are hints
        short = np.flatnonzero((n > 1) & (n <= _HINT_LETTERS))
        a, n, key = a[short], n[short], np.zeros(len(short), np.int64)
        for k in range(_HINT_LETTERS):
            letter = codes[np.minimum(a + k, len(codes) - 1)].astype(np.int64)
            fine = (letter < 128) & (letter >= 64)
            key = np.where(k < n, np.where(fine & (key >= 0), key * 32 + ((letter | 32) - 96), -1), key)
        known, group = _hints()
        at = np.minimum(np.searchsorted(known, key), len(known) - 1)
        hit = known[at] == key
        shape[words[short[hit]]] = group[at[hit]]
        before = np.concatenate([[_BETWEEN], kind[self.start[1:] - 1]])
        self.symbols = np.where(first == _BETWEEN, 0, 2 * shape + ((before == _SPACE) | (before == _BETWEEN)))
        self.marks = first == _BETWEEN


class Field:
    """Emission weights [offset, symbol, label] and transitions [label, label]."""

    def __init__(self, emit: np.ndarray, move: np.ndarray):
        self.emit, self.move = emit, move

    def scores(self, symbols: np.ndarray) -> np.ndarray:
        """[window, token, label]; symbols [window, token] are 0 beyond a window's end."""
        padded = np.pad(symbols, ((0, 0), (2, 2)))
        width = symbols.shape[1]
        return sum(self.emit[k][padded[:, k : k + width]] for k in range(len(_REACH)))

    def at(self, symbols: np.ndarray, places: np.ndarray) -> np.ndarray:
        """Scores [..., label] at some places of a row of symbols."""
        return sum(self.emit[k][symbols[places + offset]] for k, offset in enumerate(_REACH))

    def surely_outside(self, tokens: Tokens) -> np.ndarray:
        """Of each token whether the best path of its text goes through O there; true for marks.

        Take a path with a span of kind k, and put O in place of its labels. The path changes by the span's gain over O: of its
        first token, of each further one, and a bounded rest for the labels around it. The best span over a token is found from running
        sums and their running extremes; if its gain is negative, no best path has any span there.
        """
        move, outside, n = self.move, np.ones(len(tokens.symbols), bool), len(tokens.symbols)
        ends = [0, *range(1, len(_LABELS), 2)]  # labels that may follow any label
        gains = np.full((2 * len(KINDS), n), -1e3)
        for a in range(2, n - 2, SCORED):
            score = self.at(tokens.symbols, np.arange(a, min(a + SCORED, n - 2)))
            gains[:, a : a + len(score)] = (score[:, 1:] - score[:, :1]).T
        gains[:, tokens.marks] = -1e3
        for k in range(len(KINDS)):
            begin, inside = 2 * k + 1, 2 * k + 2
            first = gains[2 * k] + (move[:, begin] - move[:, 0]).max()
            more = gains[2 * k + 1] + (move[inside, inside] - move[0, 0])
            rest = max(0.0, move[begin, inside] - move[inside, inside]) + (move[[begin, inside]][:, ends] - move[0, ends]).max()
            sums = np.cumsum(more)
            from_left = np.full(n, -np.inf)  # the best span that begins before a token and reaches it
            from_left[1:] = np.maximum.accumulate(first - sums)[:-1] + sums[1:]
            to_right = np.maximum.accumulate(sums[::-1])[::-1] - sums
            outside &= np.maximum(first, from_left) + to_right + rest < -1e-4  # running sums are that exact
        return outside | tokens.marks

    def decode(self, symbols: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Best labels [window, token] by Viterbi of whole windows, which begin and end beside O."""
        padded = np.pad(symbols, ((0, 0), (2, 2)))
        return self.paths(padded.ravel(), np.arange(len(symbols)) * padded.shape[1] + 2, lengths)

    def paths(self, symbols: np.ndarray, at: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Best labels [stretch, token] by Viterbi, all stretches at once: ``at`` says where each begins in a row of symbols; O is on both sides."""
        order = np.argsort(-lengths, kind="stable")
        at, sizes = at[order], lengths[order]
        n, width, labels = len(at), int(sizes[0]), len(self.move)
        live = n - np.searchsorted(sizes[::-1], np.arange(width + 1), "right")  # stretches that have a token at each step; they are the first ones
        back, finals, move = np.zeros((width, n, labels), np.int8), np.zeros((n, labels)), self.move.T.copy()
        block = max(1, min(512, SCORED // n))
        top = len(symbols) - 3
        for t in range(width):
            m = live[t]
            if t % block == 0:  # scores of a block of tokens at a time
                score = self.at(symbols, np.minimum(np.arange(t, min(t + block, width))[:, None] + at[:m], top))
            if t == 0:
                best = score[0] + self.move[0]
            else:
                over = best[:m, None, :] + move
                back[t, :m] = over.argmax(axis=2)
                best = over.max(axis=2) + score[t % block, :m]
            if live[t + 1] < m:
                finals[live[t + 1] : m] = best[live[t + 1] :]
        now = (finals + self.move[:, 0]).argmax(axis=1)
        out, rows = np.zeros((n, width), np.int8), np.arange(n)
        for t in range(width - 1, -1, -1):
            m = live[t]
            out[:m, t] = now[:m]
            if t:
                now[:m] = back[t, rows[:m], now[:m]]
        whole = np.empty_like(out)
        whole[order] = out
        return whole


def _legal() -> np.ndarray:
    """0 where a label may follow another, else a very low score: inside follows only begin or inside of its kind."""
    out = np.zeros((len(_LABELS), len(_LABELS)))
    for j, b in enumerate(_LABELS):
        if b[0] == "I":
            for i, a in enumerate(_LABELS):
                if a not in (b, "B" + b[1:]):
                    out[i, j] = _NEVER
    return out


def _listed(text: str) -> list[tuple[int, int, int]]:
    """(symbol, start, end) of a text's tokens."""
    t = Tokens([text])
    return [(s, a - 2, z - 2) for s, a, z, mark in zip(t.symbols.tolist(), t.start.tolist(), t.end.tolist(), t.marks.tolist(), strict=True) if not mark]


@lru_cache(maxsize=2)
def fit(rules: int = 450, seed: int = 3, steps: int = 80, rate: float = 0.25, l2: float = 2e-3, hand: tuple | None = None) -> Field:
    """Train on the labelled table by Adam steps on its mean log-likelihood."""
    lines = [*(pii_lines.by_hand() if hand is None else hand), *pii_lines.by_rule(rules, seed)]
    count, found = len(lines), [_listed(t) for t, _ in lines]
    width = max(map(len, found))
    symbols, gold = np.zeros((count, width), np.int64), np.zeros((count, width), np.int64)
    lengths = np.array([max(1, len(x)) for x in found])
    for k, ((_, spans), toks) in enumerate(zip(lines, found, strict=True)):
        for t, (s, a, b) in enumerate(toks):
            symbols[k, t] = s
            for kind, x, y in spans:
                if a >= x and b <= y:
                    gold[k, t] = _LABELS.index(("B-" if a == x else "I-") + kind)
    n, labels = count, len(_LABELS)
    field = Field(np.zeros((len(_REACH), _SYMBOLS, labels)), np.zeros((labels, labels)))
    legal = _legal()
    live = np.arange(width)[None] < lengths[:, None]
    padded = np.pad(symbols, ((0, 0), (2, 2)))

    def add(to: np.ndarray, at: np.ndarray, what: np.ndarray) -> None:
        for j in range(what.shape[-1]):
            to[:, j] += np.bincount(at, what[:, j], minlength=_SYMBOLS)

    def log_sum(x: np.ndarray, axis: int) -> np.ndarray:
        top = x.max(axis=axis, keepdims=True)
        return (top + np.log(np.exp(x - top).sum(axis=axis, keepdims=True))).squeeze(axis)

    one_hot = np.eye(labels)[gold] * live[..., None]
    first, second = [np.zeros_like(field.emit), np.zeros_like(field.move)], [np.zeros_like(field.emit), np.zeros_like(field.move)]
    for step in range(1, steps + 1):
        score, move = field.scores(symbols), field.move + legal
        ahead, behind = np.zeros((n, width, labels)), np.zeros((n, width, labels))
        ahead[:, 0] = score[:, 0] + move[0]
        for t in range(1, width):
            ahead[:, t] = np.where(live[:, t, None], log_sum(ahead[:, t - 1, :, None] + move[None], 1) + score[:, t], ahead[:, t - 1])
        behind[:, width - 1] = move[:, 0]
        for t in range(width - 2, -1, -1):
            behind[:, t] = np.where(live[:, t + 1, None], log_sum(move[None] + (score[:, t + 1] + behind[:, t + 1])[:, None], 2), move[:, 0])
        total = log_sum(ahead[:, -1] + move[:, 0], 1)
        marginal = np.exp(ahead + behind - total[:, None, None]) * live[..., None]
        gap = (one_hot - marginal) / n
        d_emit = np.zeros_like(field.emit)
        for k in range(len(_REACH)):
            add(d_emit[k], padded[:, k : k + width].ravel(), gap.reshape(-1, labels))
        d_move = np.zeros_like(field.move)
        for t in range(1, width):
            both = np.exp(ahead[:, t - 1, :, None] + move[None] + (score[:, t] + behind[:, t])[:, None] - total[:, None, None]) * live[:, t, None, None]
            d_move += (np.einsum("ni,nj->ij", one_hot[:, t - 1], one_hot[:, t]) - both.sum(axis=0)) / n
        last = lengths - 1
        d_move[0] += gap[:, 0].sum(axis=0)
        d_move[:, 0] += gap[np.arange(n), last].sum(axis=0)
        for w, g, m, v in zip((field.emit, field.move), (d_emit, d_move), first, second, strict=True):
            g -= l2 * w
            m *= 0.9
            m += 0.1 * g
            v *= 0.999
            v += 0.001 * g * g
            w += rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    field.move = field.move + legal
    return field


#: The written forms of an address: "@" or "at" (free or in brackets), and "." or "dot" likewise.
_AT = r"(?:\s?@\s?|\s?[(\[]\s?(?:at|@)\s?[)\]]\s?|\s+at\s+)"
_DOT = r"(?:\.|\s?[(\[]\s?(?:dot|\.)\s?[)\]]\s?|\s+dot\s+)"
_ADDRESS = re.compile(rf"[\w.%+-]+{_AT}[\w-]+(?:{_DOT}[\w-]+)+", re.I)


def _passes(kind: str, span: str) -> bool:
    numbers = "".join(_DIGITS.findall(span))
    if kind == "email":
        return bool(_ADDRESS.fullmatch(span))
    if kind == "ip":
        parts = re.findall(r"[0-9]+", span)
        return len(parts) == 4 and _octets(parts) and bool(re.fullmatch(r"[0-9\s.\[\]()]+", span))
    if kind == "card":
        return 13 <= len(numbers) <= 19 and luhn(numbers) and bool(re.fullmatch(r"[0-9][0-9\s./_-]+", span))
    return 9 <= len(numbers) <= 15 and bool(re.fullmatch(r"[+(]?[0-9][0-9\s().\-/]+[0-9]", span)) and not numbers == span


def labelled(texts: list[str], field: Field) -> list[list[tuple[str, int, int]]]:
    """The field's spans (kind, start, end) of each text, in order."""
    tokens = Tokens(texts)
    rest = ~field.surely_outside(tokens)
    turn = np.flatnonzero(np.diff(np.concatenate([[0], rest.view(np.int8), [0]])))
    begin, size = turn[::2], turn[1::2] - turn[::2]
    order = np.argsort(size, kind="stable")
    out: list[list] = [[] for _ in texts]
    at = 0
    while at < len(order):
        # stretches of like length, a bounded number of tokens; a longer one alone
        some = order[at : at + LANES]
        while len(some) > 1 and len(some) * size[some[-1]] > BLOCK:
            some = some[: len(some) // 2]
        at += len(some)
        labels = field.paths(tokens.symbols, begin[some], size[some])
        for row in np.flatnonzero(labels.any(axis=1)).tolist():
            path, t, n = labels[row].tolist(), 0, int(size[some[row]])
            while t < n:
                label = path[t]
                u = t + 1
                if label:
                    while u < n and path[u] == label + label % 2:
                        u += 1
                    a, z = int(tokens.start[begin[some[row]] + t]), int(tokens.end[begin[some[row]] + u - 1])
                    text = int(np.searchsorted(tokens.first, a, "right")) - 1
                    first = int(tokens.first[text])
                    out[text].append((_LABELS[label][2:], a - first, z - first))
                t = u
    return [sorted(spans, key=lambda s: s[1]) for spans in out]


def _added(text: str, base: list, spans: list) -> list[tuple[str, int, int]]:
    """The spans that pass their kind's test and overlap no base span."""
    taken = sorted((a, z) for _, a, z in base)
    starts, reach = [a for a, _ in taken], []
    for _, z in taken:
        reach.append(max(z, reach[-1] if reach else 0))
    out = []
    for kind, a, z in spans:
        while z > a and text[z - 1] in ".,;:":
            z -= 1
        before = bisect_left(starts, z)
        if _passes(kind, text[a:z]) and not (before and reach[before - 1] > a):
            out.append((kind, a, z))
    return out


def all_spans(texts: list[str], field: Field) -> list[tuple[list, list]]:
    """Per text its base spans and all spans, both by kind as listed, then start."""
    rank, out, at = {kind: k for k, kind in enumerate(KINDS)}, [], 0
    while at < len(texts):  # as many as fit the room, one at least
        end, room = at + 1, ROOM - len(texts[at])
        while end < len(texts) and (room := room - len(texts[end])) >= 0:
            end += 1
        for text, spans in zip(texts[at:end], labelled(texts[at:end], field), strict=True):
            base = base_spans(text)
            out.append((base, sorted({*base, *_added(text, base, spans)}, key=lambda s: (rank[s[0]], s[1], s[2]))))
        at = end
    return out


def _joined(spans) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def found(docs: DataFrame) -> DataFrame:
    """One row per document: counts and digest of the base spans, and all spans. One scan, no shuffle."""
    field = fit()

    def run(batches):
        import pyarrow as pa

        for b in sliced(batches):
            both = all_spans([t or "" for t in b.column(1).to_pylist()], field)
            counts = [pa.array([sum(s[0] == kind for s in own) for own, _ in both], pa.int64()) for kind in KINDS]
            digest = [hashlib.sha256(_joined(own).encode()).hexdigest() for own, _ in both]
            yield pa.RecordBatch.from_arrays([b.column(0), *counts, pa.array(digest, pa.string()), pa.array([_joined(x) for _, x in both], pa.string())], ["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans"])

    return docs.select(docs["doc_id"].cast("long"), docs["text"].cast("string")).mapInArrow(run, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string")


def redact(text: str, spans) -> str:
    """The text with each span replaced by its kind in brackets; overlapping spans become the first one's kind."""
    out, at = [], 0
    for kind, a, b in sorted(spans, key=lambda s: (s[1], -s[2])):
        if a >= at:
            out += [text[at:a], f"[{kind.upper()}]"]
            at = b
        elif b > at:
            at = b
    return "".join([*out, text[at:]])


def redacted(docs: DataFrame) -> DataFrame:
    """``docs`` with personal data replaced in ``text``, and ``n_chars``, if there, counted anew for changed texts; all else as it was."""
    field, names = fit(), docs.columns
    where, counted = names.index("text"), names.index("n_chars") if "n_chars" in names else None

    def run(batches):
        import pyarrow as pa

        for b in sliced(batches):
            texts = b.column(where).to_pylist()
            both = all_spans([t or "" for t in texts], field)
            new = [redact(t, spans) if spans else t for t, (_, spans) in zip(texts, both, strict=True)]
            columns = list(b.columns)
            columns[where] = pa.array(new, b.column(where).type)
            if counted is not None:
                old = b.column(counted).to_pylist()
                columns[counted] = pa.array([len(n) if s else o for n, o, (_, s) in zip(new, old, both, strict=True)], b.column(counted).type)
            yield pa.RecordBatch.from_arrays(columns, names)

    return docs.mapInArrow(run, docs.schema)
