"""Sentence boundaries by a hidden-event n-gram model, across languages and scripts.

A paragraph is a row of tokens (a word with the punctuation it carries; single characters where a script writes no blanks). Between two
tokens a hidden event may stand, the sentence boundary, which the model treats as one more symbol of the row. An interpolated n-gram model over
words, falling back on their shapes, gives the probability of the row with and without the event at each gap; a gap is possible where
a terminal mark, a closing sign or, in Thai, a blank between two Thai words stands. Inside quotation marks and brackets no event is possible. The
decisions of neighbouring gaps depend on each other (a list number starts a sentence only behind a boundary), so the posterior of each
event comes from a forward-backward pass over the gaps of the paragraph; an event is set above 0.5.

Where a stretch goes on without any mark for longer than the sentences of the collection do, an event is possible between any two of its words
(characters, in scripts without blanks). A second table of the model, counted over the sentences found in training with their marks taken off, tells how
often a word ends, starts or continues a sentence; together with the lengths of sentences it gives the probability of every way to cut the
stretch, and forward-backward over all of them the posterior of each event. Where nothing tells one place from another, none passes 0.5 and the stretch stays whole.

The model is trained on all unlabelled paragraphs of the collection by expectation-maximisation. Every paragraph's start and end are events that can be seen, and
from how often a token ends paragraphs the first expectations follow; the pieces an older splitter left are not used.

Defined results. Null, empty and blank texts have no sentence. Ranges count code points, have no blank at either end and together cover all
but blanks. A text in which no event passes is one sentence. The same row twice gives its sentences once.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from functools import lru_cache
from math import exp, log

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.stage import written

_ROUNDS = 4
_REMEMBERED = 200_000

_THAI = "฀-๿"
_HAN = "぀-ヿ㐀-鿿豈-﫿"
_END = ".!?…。！？।॥"
_FULL = "。！？।॥"  # marks that end nothing but sentences
_CLOSE = "\"'”’»)\\]）」』》"
_OPEN = "\"'“‘„«(\\[（「『《¿¡"
# Possible gaps: behind terminal marks and what closes with them; a Thai blank between two Thai characters. Each pattern begins with a set of
# characters, which the regular expression engine looks for much faster than for alternatives.
_MARK = (
    rf"[{_END}](?:(?<=[{_FULL}])[{_FULL}]*[{_CLOSE}]*|[{_END}]*(?:\s*»|[{_CLOSE}])*(?=\s|[{_OPEN}]|[^\W\d_a-z]|[{_HAN}])|(?<=[^\W\d]{{3}}[.!?])(?=\d))"
)
_GAP_AT_MARK = re.compile(_MARK)
_GAP = re.compile(
    rf"{_MARK}|\s(?:(?<=[{_THAI}]\s)\s*(?=[{_THAI}])|(?<=\)\s)\s*(?=\()"
    rf"|(?<=[{_THAI}]\s)\s*(?=(?:[^\s{_THAI}]+\s+){{3}}[^\s{_THAI}]|[^\s{_THAI}]*[{_HAN}ऀ-ॿЀ-ӿ]))"
)
_GAP_AT_BLANK = re.compile(rf"[{_THAI})](?:(?<!\))\s|(?<=\))\s+\()")  # without one, no gap stands at a blank
# Signs in pairs. A straight quotation mark opens behind a blank or opening sign and closes before a blank, mark or closing sign.
_QUOTED = re.compile(
    r'["“„«「『(（\[](?:(?<=")(?<![^\s(\[“«„—:：.!?。！？]")(?=\S)[^"]*?(?<=\S)"(?=[\s.,;:!?)\]—]|$|[A-ZÀ-Þ(])'
    r"|(?<=“)[^“”]+”|(?<=„)[^„“”]+[“”]|(?<=«)[^«»]+»|(?<=「)[^「」]+」|(?<=『)[^『』]+』|(?<=\()[^()]+\)|(?<=（)[^（）]+）|(?<=\[)[^\[\]]+\])"
)
_TOKEN = re.compile(rf"[{_HAN}]|[^\s{_HAN}]+")
_RIGHT = re.compile(rf"\s*([{_OPEN}]*)([{_HAN}]|[{_THAI}]+|[\w'’.-]+|\S)?(\S*)\s*(\S{{0,20}})")
_HAN_LAST = re.compile(f"[{_HAN}](?=[^{_HAN}]*$)")
_HAN_CHAR = re.compile(f"[{_HAN}]")
START = "<s>"


def _left(before: str) -> tuple[str, str]:
    """The last two tokens of a text."""
    words = before.rsplit(None, 2)
    if not words:
        return "", ""
    last = words[-1]
    if last.isascii() or (m := _HAN_LAST.search(last)) is None:
        return (words[-2] if len(words) > 1 else ""), last
    at = m.start() if m.end() == len(last) else m.end()
    return last[:at], last[at:]


@lru_cache(maxsize=1 << 16)
def shape(word: str) -> str:
    """The form of a word: which script, which case, which signs."""
    core = word.strip(_OPEN.replace("\\", "") + _CLOSE.replace("\\", "") + _END + ",;:")
    tail = word[len(word.rstrip(_END + _CLOSE.replace("\\", ""))) :] if word else ""
    if not core:
        kind = "sign"
    elif core[0].isdigit():
        kind = "number" if core.replace(".", "").replace(",", "").replace("-", "").replace("%", "").isdigit() else "code"
    elif len(core) == 1 and core.isupper():
        kind = "letter"
    elif core.isupper() and len(core) > 1:
        kind = "capitals"
    elif core[0].isupper():
        kind = "title" if core[1:].islower() and core.isalpha() else "title mixed"
    elif "฀" <= core[0] <= "๿":
        kind = "thai"
    elif "぀" <= core[0] <= "鿿":
        kind = "han"
    elif "ऀ" <= core[0] <= "ॿ":
        kind = "hindi"
    elif core[0].islower():
        kind = "short" if len(core) < 4 else "low"
    else:
        kind = "other"
    return f"{kind} {tail}" if tail else kind


class Gap:
    """A possible event: where it stands, the tokens around it, and whether the gap before lies one token back."""

    __slots__ = ("end", "near", "l1", "l2", "r1", "r2", "glued")

    def __init__(self, end, near, l1, l2, r1, r2, glued):
        self.end, self.near, self.l1, self.l2, self.r1, self.r2, self.glued = end, near, l1, l2, r1, r2, glued


def gaps(text: str) -> list[Gap]:
    """The possible events of a paragraph, in order."""
    closed = [m.span() for m in _QUOTED.finditer(text)]
    out: list[Gap] = []
    k = 0
    last_end, text_end = -1, len(text.rstrip())
    for m in (_GAP_AT_MARK if _GAP_AT_BLANK.search(text) is None else _GAP).finditer(text):
        start, end = m.span()
        if text[start].isspace():
            end = start
        while k < len(closed) and closed[k][1] <= start:
            k += 1
        inside = False
        if k < len(closed) and closed[k][0] < start:
            # Within the pair only its last mark may end a sentence, together with the closing sign.
            shut = closed[k][1]
            if end < shut and text[end:shut].strip(_CLOSE.replace("\\", "") + " »"):
                inside = True
            else:
                end = max(end, shut)
                while end < len(text) and text[end] in "\"'”’»)]）」』》":
                    end += 1
        if inside or end <= last_end or end >= text_end:
            continue
        l2, l1 = _left(text[max(0, end - 60) : end])
        opening, head, tail, after = _RIGHT.match(text, end).groups()
        glued = not text[end].isspace()
        r1 = (opening or "") + (head or "")
        r2 = (tail if glued and tail and not head else "") or after or ""
        between = text[last_end:end].split(None, 1) if last_end >= 0 else ()
        near = len(between) == 1 and _HAN_CHAR.search(between[0]) is None
        out.append(Gap(end, near, l1, l2, r1, r2, glued))
        last_end = end
    return out


class EventModel:
    """Counts of an interpolated hidden-event n-gram model, and the potentials that follow."""

    def __init__(self, vocabulary: set[str]):
        self.vocabulary = vocabulary
        self.event: dict = {}  # context -> [events, all]
        self.next: dict = {}  # (with event, context) -> count; True and False -> all
        self.known: dict = {}  # probabilities worked out before, at most _REMEMBERED; and what the two sides told
        self.lefts: dict = {}
        self.rights: dict = {}
        self.bare: Bare | None = None  # for stretches without marks

    def contexts(self, l2: str, l1: str) -> list[tuple]:
        a, b = (l1 if l1 in self.vocabulary else shape(l1)), (START if l2 == START else l2 if l2 in self.vocabulary else shape(l2))
        return [(b, a), (a,), (shape(l1),)]

    def follow(self, r1: str, r2: str, glued: bool) -> list[tuple]:
        a, b = (r1 if r1 in self.vocabulary else shape(r1)), (r2 if r2 in self.vocabulary else shape(r2))
        g = "" if not glued else "+"
        return [(g + a, b), (g + a,), (g + shape(r1),)]

    def odds(self, gap: Gap, behind_event: bool) -> float:
        """log P(event) - log P(no event) at a gap, from both sides of it."""
        before, after = (START if behind_event else gap.l2, gap.l1), (gap.r1, gap.r2, gap.glued)
        if (left := self.lefts.get(before)) is None:
            if len(self.lefts) >= _REMEMBERED:
                self.lefts.clear()
            contexts = self.contexts(*before)
            left = self.lefts[before] = self.left(contexts, gap.l1[-1:] in _FULL), contexts[1][0]
        if (right := self.rights.get(after)) is None:
            if len(self.rights) >= _REMEMBERED:
                self.rights.clear()
            follow = self.follow(*after)
            right = self.rights[after] = self.right(follow), follow[1][0]
        return self.weigh(*left, *right)

    def forget(self) -> None:
        """What was worked out goes; the counts stay."""
        for held in (self.known, self.lefts, self.rights):
            held.clear()

    def left(self, contexts: list[tuple], full: bool) -> float:
        """What stands before a gap tells."""
        p = 0.9 if full else 0.5
        for c in reversed(contexts):  # from the widest to the narrowest
            seen = self.event.get(c)
            if seen:
                p = (seen[0] + 3.0 * p) / (seen[1] + 3.0)
        p = min(max(p, 1e-4), 1 - 1e-4)
        return log(p / (1 - p))

    def right(self, follow: list[tuple]) -> float:
        """What stands behind a gap tells."""
        ratio = 0.0
        for f in reversed(follow):
            on, off = self.next.get((True, f), 0.0), self.next.get((False, f), 0.0)
            prior = exp(max(min(ratio, 20), -20))
            share = prior * self.next[True] / (prior * self.next[True] + self.next[False])
            q = (on + 2.0 * share) / (on + off + 2.0)
            q = min(max(q, 1e-4), 1 - 1e-4)
            ratio = log(q / (1 - q)) - log(self.next[True] / self.next[False])
        return ratio

    def weigh(self, value: float, before: str, ratio: float, after: str) -> float:
        # What follows, given what stands before: the pair, where it was seen often.
        pair = self.event.get((before, after, "pair"))
        if pair:
            q = (pair[0] + exp(value + ratio) / (1 + exp(value + ratio)) * 4.0 if value + ratio < 30 else pair[0] + 4.0) / (pair[1] + 4.0)
            q = min(max(q, 1e-4), 1 - 1e-4)
            return log(q / (1 - q))
        return value + ratio

    def posteriors(self, row: list[Gap]) -> list[float]:
        """P(event) of each gap, forward and backward."""
        known = self.known
        out: list[float] = []
        chain: list[tuple[float, float]] = []  # a gap that does not lie one token behind the one before does not depend on it
        for k, g in enumerate(row):
            key = (g.l2, g.l1, g.r1, g.r2, g.glued)
            if (plain := known.get(key)) is None:
                if len(known) >= _REMEMBERED:
                    known.clear()
                plain = known[key] = _sigmoid(self.odds(g, False))
            if g.near and k:
                chain.append((plain, 0.003 if shape(g.l1).startswith("number .") else _sigmoid(self.odds(g, True))))
                continue
            if len(chain) > 1:
                out[-1:] = _passed(chain)
            if not k and not g.l2 and shape(g.l1).startswith("number ."):
                plain = 0.003  # a list number opens the paragraph
            out.append(plain)
            chain = [(plain, plain)]
        if len(chain) > 1:
            out[-1:] = _passed(chain)
        return out


def _passed(pots: list[tuple[float, float]]) -> list[float]:
    """P(event) of each of a row of gaps, forward and backward. pots: P(event) behind no event and behind one."""
    n = len(pots)
    forward = [(1 - pots[0][0], pots[0][0])]
    for k in range(1, n):
        a, b = forward[-1]
        p, q = pots[k]
        off, on = a * (1 - p) + b * (1 - q), a * p + b * q
        forward.append((off / (off + on), on / (off + on)))
    backward = (1.0, 1.0)
    out = [0.0] * n
    for k in range(n - 1, -1, -1):
        a, b = forward[k][0] * backward[0], forward[k][1] * backward[1]
        out[k] = b / (a + b) if a + b else 0.0
        if k:
            p, q = pots[k]
            backward = ((1 - p) * backward[0] + p * backward[1], (1 - q) * backward[0] + q * backward[1])
            top = max(backward)
            backward = (backward[0] / top, backward[1] / top)
    return out


def _sigmoid(x: float) -> float:
    return 1 / (1 + exp(-max(min(x, 30.0), -30.0)))


def _first_guess(gap: Gap, ends: Counter, seen: Counter, rate: float) -> float:
    """P(event) before any model: by how often the token left of the gap ends a paragraph."""
    r = gap.r1.lstrip(_OPEN.replace("\\", ""))
    last = gap.l1.rstrip("\"'”’»)]）」』》")[-1:]
    if not gap.l1.endswith(tuple(_END + "\"'”’»)]）」』》")) and not _HAN_CHAR.search(gap.l1):
        return 0.9  # a Thai blank
    if last in "。！？।॥":
        return 0.95 if gap.l1[-1:] == last or r[:1].lower() == r[:1].upper() and not r[:1] in "とってと" else 0.5
    if r[:1].islower():
        return 0.02
    if last in "!?":
        return 0.9
    n = seen[gap.l1]
    share = ends[gap.l1] / n * rate if n >= 8 else None
    if share is not None:
        return min(max(share, 0.03), 0.97)
    kind = shape(gap.l1)
    if kind.startswith(("letter", "short")):
        return 0.3
    return 0.85


#: Expectations are summed as whole numbers of this share, so that no order of the texts or tasks changes a sum.
_ONE = 1 << 30
#: Distinct keys a task counts before it hands them on.
_HELD = 200_000
_FIELD, _ELEMENT, _SIDE = "\x1f", "\x1e", "\x1d"  # blanks: no token holds one
#: A pair seen less often tells nothing.
_PAIRED = 3 * _ONE


def observed(text: str, words: Counter, ends: Counter, seen: Counter, rows: Counter) -> None:
    """Counts what the training needs of a paragraph: tokens, its end and start, and its gaps as chains.

    A gap depends on the one before it only where that lies one token back. So a chain, a longest run of such gaps, is judged by itself, and
    equal chains of all paragraphs are judged once.
    """
    tokens = text.split() if _HAN_CHAR.search(text) is None else _TOKEN.findall(text)
    words.update(tokens)
    if tokens:
        ends[tokens[-1]] += 1
        seen[tokens[-1]] += 1
    chain: list[str] = []
    for k, g in enumerate(gaps(text)):
        seen[g.l1] += 1
        words[g.r1] += 1
        if chain and not g.near:
            rows["chain", _ELEMENT.join(chain)] += 1
            chain = []
        chain.append(_FIELD.join((g.l2, g.l1, g.r1, g.r2, "+" if g.glued else "", "" if k else "first")))
    if chain:
        rows["chain", _ELEMENT.join(chain)] += 1
    tokens = _TOKEN.findall(text[-60:])
    if tokens:
        rows["end", _FIELD.join((tokens[-2] if len(tokens) > 1 else START, tokens[-1]))] += 1
    opening, first, _, after = _RIGHT.match(text[:80].lstrip()).groups()
    rows["start", _FIELD.join(((opening or "") + (first or ""), after or ""))] += 1


class Guess:
    """What is known before the first round: the words that count by themselves, and how often tokens end paragraphs."""

    def __init__(self, words: dict[str, int], ends: dict[str, int], seen: dict[str, int], total: int, paragraphs: int):
        self.vocabulary = {w for w, n in words.items() if n >= 6}
        self.seen = Counter({w: n for w, n in seen.items() if n >= 8})  # below, no share is taken
        self.ends = Counter({w: n for w, n in ends.items() if w in self.seen})
        self.rate = max(1.0, (total + paragraphs) / max(1, paragraphs) * 0.7)

    def reduced(self, kind: str, key: str, model: EventModel) -> str:
        """A chain, end or start with words only as far as the model tells them apart, so that more of them are equal."""
        if kind == "end":
            (b, a), _, (s,) = model.contexts(*key.split(_FIELD))
            return _FIELD.join((b, a, s, ""))
        if kind == "start":
            r1, r2 = key.split(_FIELD)
            return _FIELD.join((*model.follow(r1, r2, False)[0], shape(r1)))
        out = []
        for element in key.split(_ELEMENT):
            l2, l1, r1, r2, glued, first = element.split(_FIELD)
            (b, a), _, (s,) = model.contexts(l2, l1)
            (x, y), _, (t,) = model.follow(r1, r2, bool(glued))
            p = _first_guess(Gap(0, False, l1, l2, r1, r2, bool(glued)), self.ends, self.seen, self.rate)
            opens = first and not l2 and s.startswith("number .")
            out.append(_SIDE.join((_FIELD.join((b, a, s, "f" if l1[-1:] in _FULL else "")), _FIELD.join((x, y, t)), "o" if opens else "", repr(p))))
        return _ELEMENT.join(out)


class Sums:
    """What reduced chains, ends and starts tell under a model, by their first guess if there is none.

    The rounds weigh the two sides of a gap by themselves. Pairs of both sides are counted from these beliefs and used only once the rounds are over:
    a pair that was seen often would else only repeat what it was first taken for. So only the last round counts them.
    """

    def __init__(self, model: EventModel | None, paired: bool = True):
        self.model = model
        self.paired = paired
        self.lefts: dict = {}  # odds worked out before
        self.rights: dict = {}
        self.clear()

    def clear(self) -> None:
        # The sides stay written as they come, and are taken apart only where they are told.
        self.before: dict = defaultdict(lambda: [0, 0, 0, 0])  # left -> events, all, and both of them behind an event one token back
        self.after: dict = defaultdict(lambda: [0, 0])  # right -> behind events, behind none
        self.pairs: dict = defaultdict(lambda: [0, 0])

    def __len__(self) -> int:
        return len(self.before) + len(self.after) + len(self.pairs)

    def _left(self, left: str) -> float:
        if (odds := self.lefts.get(left)) is None:
            if len(self.lefts) >= _REMEMBERED:
                self.lefts.clear()
            b, a, s, full = left.split(_FIELD)
            odds = self.lefts[left] = self.model.left([(b, a), (a,), (s,)], bool(full))
        return odds

    def _right(self, right: str) -> float:
        if (odds := self.rights.get(right)) is None:
            if len(self.rights) >= _REMEMBERED:
                self.rights.clear()
            x, y, t = right.split(_FIELD)
            odds = self.rights[right] = self.model.right([(x, y), (x,), (t,)])
        return odds

    def add(self, kind: str, key: str, n: int) -> None:
        """Counts ``n`` equal ones."""
        every = n * _ONE
        if kind == "end":  # of a paragraph: an event that can be seen, and so its start
            cell = self.before[key]
            cell[0] += every
            cell[1] += every
            return
        if kind == "start":
            self.after[key][0] += every
            return
        if _ELEMENT not in key:  # a gap by itself, as most are
            left, right, opens, guess = key.split(_SIDE)
            p = float(guess) if self.model is None else 0.003 if opens else _sigmoid(self._left(left) + self._right(right))
            one = round(p * _ONE) * n
            cell = self.before[left]
            cell[0] += one
            cell[1] += every
            cell = self.after[right]
            cell[0] += one
            cell[1] += every - one
            if self.paired:
                cell = self.pairs[left.split(_FIELD, 2)[1], right[: right.index(_FIELD)]]
                cell[0] += one
                cell[1] += every
            return
        elements = [e.split(_SIDE) for e in key.split(_ELEMENT)]
        if self.model is None:
            belief = [float(e[3]) for e in elements]
        else:
            pots = []
            for k, (left, right, opens, _) in enumerate(elements):
                after = self._right(right)
                plain = _sigmoid(self._left(left) + after)
                if k:
                    number = left.split(_FIELD)[2].startswith("number .")
                    pots.append((plain, 0.003 if number else _sigmoid(self._left(START + left[left.index(_FIELD) :]) + after)))
                else:
                    pots.append((0.003, 0.003) if opens else (plain, plain))
            belief = _passed(pots)
        before = 0.0
        for k, ((left, right, *_), p) in enumerate(zip(elements, belief)):
            one = round(p * _ONE) * n
            cell = self.before[left]
            cell[0] += one
            cell[1] += every
            if k:
                cell[2] += round(p * before * _ONE) * n
                cell[3] += round(before * _ONE) * n
            cell = self.after[right]
            cell[0] += one
            cell[1] += every - one
            if self.paired:
                cell = self.pairs[left.split(_FIELD, 2)[1], right[: right.index(_FIELD)]]
                cell[0] += one
                cell[1] += every
            before = p

    def told(self) -> dict[tuple[str, str], list[int]]:
        """(kind, context) -> [events, all], or [behind events, behind none]."""
        out: dict = defaultdict(lambda: [0, 0])

        def put(kind: str, one: int, two: int, *context: str) -> None:
            cell = out[kind, _FIELD.join(context)]
            cell[0] += one
            cell[1] += two

        for left, (one, every, behind, both) in self.before.items():
            b, a, s, _ = left.split(_FIELD)
            if every > both:
                put("event", one - behind, every - both, b, a)
            if both:
                put("event", behind, both, START, a)
            put("event", one, every, a)
            put("event", one, every, s)
        for right, (on, off) in self.after.items():
            x, y, t = right.split(_FIELD)
            put("next", on, off, x, y)
            put("next", on, off, x)
            put("next", on, off, t)
            put("all", on, off)
        for (a, x), (one, every) in self.pairs.items():
            put("pair", one, every, a, x)
        return out


def _model(vocabulary: set[str], sums: dict) -> EventModel:
    """The model of a round from the sums of all expectations."""
    model = EventModel(vocabulary)
    on, off = sums.get(("all", ""), (0, 0))
    model.next = {True: on / _ONE + 1, False: off / _ONE + 1}
    for (side, key), (one, two) in sums.items():
        context = tuple(key.split(_FIELD))
        if side == "event":
            model.event[context] = (one / _ONE, two / _ONE)
        elif side == "next":
            model.next[True, context], model.next[False, context] = one / _ONE, two / _ONE
        elif side == "pair" and two >= _PAIRED:
            model.event[*context, "pair"] = (one / _ONE, two / _ONE)
    return model


def train(texts: list[str], rounds: int = _ROUNDS) -> EventModel:
    """A model from unlabelled paragraphs in memory: what `fit` gives on a table of them. The order of the texts does not matter."""
    words, ends, seen, rows = Counter(), Counter(), Counter(), Counter()
    for t in texts:
        observed(t, words, ends, seen, rows)
    guess = Guess(words, ends, seen, sum(n * (key.count(_ELEMENT) + 1) for (kind, key), n in rows.items() if kind == "chain"), len(texts))
    model, fresh, reduced = None, EventModel(guess.vocabulary), Counter()
    for (kind, key), n in rows.items():
        reduced[kind, guess.reduced(kind, key, fresh)] += n
    for k in range(rounds):
        sums = Sums(model, k == rounds - 1)
        for (kind, key), n in reduced.items():
            sums.add(kind, key, n)
        model = _model(guess.vocabulary, sums.told())
    model = model or fresh
    bare = Bare()
    for t in texts:
        bare.learn(t, split(t, model))
    bare.settle()
    model.forget()
    model.bare = bare
    return model


_SIGN = re.compile(rf"[{_HAN}{_THAI}]|[^\s{_HAN}{_THAI}]+")
_MARKS = _END + _CLOSE.replace("\\", "") + _OPEN.replace("\\", "")
_MARKS_AND_BLANK = _MARKS + " "


def _units(text: str) -> list[tuple[int, int]]:
    """Words, and single characters where no blanks part words."""
    return [m.span() for m in _SIGN.finditer(text)]


class Bare:
    """How words end, start and go on within sentences, without their marks; and how long sentences are."""

    def __init__(self):
        self.left: dict = defaultdict(lambda: [0, 0])  # what stands before a place -> [events, places]
        self.right: dict = defaultdict(lambda: [0, 0])
        # Not yet told apart into contexts. Words with blanks between them have one form on both sides: all of them, and the ones that stand on one side only.
        self.units: dict[str, Counter] = {k: Counter() for k in ("before", "ending", "after", "starting", "words", "last", "first")}
        self.known: dict = {}  # odds worked out before, at most _REMEMBERED
        self.lengths: dict[bool, Counter] = {False: Counter(), True: Counter()}  # by whether words have blanks between them

    @staticmethod
    def wide(text: str) -> bool:
        """Whether most units of a text are characters of a script without blanks."""
        return 2 * len(_WIDE.findall(text)) > len(_SIGN.findall(text))

    def _before(self, text: str, spans: list, i: int, level: bool = False) -> list:
        a, b = spans[i]
        if b - a == 1 and _WIDE.match(text, a):
            return ["", text[a:b], text[max(0, a - 1) : b], text[max(0, a - 2) : b]]
        word = text[a:b].strip(_MARKS)
        low = "=" + word.lower()
        return ["", low] if level else ["", shape(word), low, word]

    def _after(self, text: str, spans: list, i: int, level: bool = False) -> list:
        a, b = spans[i]
        if b - a == 1 and _WIDE.match(text, a):
            return ["", text[a:b], text[a : b + 1], text[a : b + 2]]
        word = text[a:b].strip(_MARKS)
        low = "=" + word.lower()
        return ["", low] if level else ["", shape(word), low, word]

    def learn(self, text: str, ranges: list[tuple[int, int]]) -> None:
        """Counts the sentences of a text, as far as they are told by their marks."""
        plain = _WIDE.search(text) is None
        found: dict[str, list] = {k: [] for k in self.units}
        for k, (a, b) in enumerate(ranges):
            bare = text[a:b].rstrip(_MARKS_AND_BLANK)
            blanks = plain or _WIDE.search(bare) is None
            if blanks:
                before = after = bare.split()
                wide = False
            else:
                spans, wide = _units(bare), self.wide(bare)
                own = [y - x == 1 and _WIDE.match(bare, x) for x, y in spans]
                before = [bare[max(0, x - 2) : y] if w else bare[x:y] for w, (x, y) in zip(own, spans)]
                after = [bare[x : x + 3] if w else bare[x:y] for w, (x, y) in zip(own, spans)]
            if not before:
                continue
            self.lengths[wide][len(before)] += 1
            final = k == len(ranges) - 1
            if not final:
                found["ending"].append(before[-1])
            if k:
                found["starting"].append(after[0])
            if blanks:
                found["words"] += before
                if final:
                    found["last"].append(before[-1])
                if not k:
                    found["first"].append(after[0])
            else:
                found["before"] += before[:-1] if final else before
                found["after"] += after if k else after[1:]
        for kind, units in found.items():
            if units:
                self.units[kind].update(units)

    def told(self) -> None:
        """Counts of units become counts of their contexts."""

        def put(side: dict, contexts: list, events: int, places: int) -> None:
            for c in contexts:
                cell = side[c or 0]
                cell[0] += events
                cell[1] += places

        units = self.units
        for unit, n in units["words"].items():
            contexts = self._before(unit, [(0, len(unit))], 0)
            for side, edge, events in ((self.left, "last", "ending"), (self.right, "first", "starting")):
                if places := n + units["before" if edge == "last" else "after"].pop(unit, 0) - units[edge][unit]:
                    put(side, contexts, units[events][unit], places)
        for side, own, places, events in ((self.left, self._before, "before", "ending"), (self.right, self._after, "after", "starting")):
            for unit, n in units[places].items():
                # A unit of a script without blanks came with its neighbours; it is the last of them before a place, the first after it.
                if places == "before":
                    span = (len(unit) - 1, len(unit)) if _WIDE.match(unit, len(unit) - 1) else (0, len(unit))
                else:
                    span = (0, 1) if _WIDE.match(unit) else (0, len(unit))
                put(side, own(unit, [span], 0), units[events][unit], n)
        self.units = {k: Counter() for k in units}

    def rows(self) -> list[tuple]:
        """The counts as rows that can be summed over tasks: (kind, key, events, places, 0)."""
        sides = [(kind, c or "", *cell, 0) for kind, side in (("left", self.left), ("right", self.right)) for c, cell in side.items()]
        return sides + [(f"length {'wide' if wide else 'plain'}", str(k), n, 0, 0) for wide, seen in self.lengths.items() for k, n in seen.items()]

    def gather(self, rows: Iterator[tuple]) -> None:
        for kind, key, one, two, _ in rows:
            if kind in ("left", "right"):
                cell = (self.left if kind == "left" else self.right)[key or 0]
                cell[0] += one
                cell[1] += two
            else:
                self.lengths[kind == "length wide"][int(key)] += one

    def settle(self) -> None:
        """Ready to be sent: rare contexts left out, lengths as logarithms of shares."""
        self.told()
        self.left, self.right = ({k: tuple(v) for k, v in side.items() if v[1] >= 2 or k == 0} for side in (self.left, self.right))
        self.longest, self.prior = {}, {}
        for wide, seen in self.lengths.items():
            total = sum(seen.values())
            most = max(seen, default=0)
            self.longest[wide] = most * 3 // 2
            raw = np.array([sum(seen.get(n + d, 0) for d in (-1, 0, 1)) / 3 for n in range(self.longest[wide] + 1)])
            # Longer ones are never ruled out: they take a small constant share each.
            self.prior[wide] = np.log((raw + 0.01) / (total + 0.01 * (len(raw) + 1)))
        self.lengths = {}
        # A stretch of fewer characters is never longer than the longest sentence.
        self.shortest = min([n for n in self.longest.values() if n], default=0)

    def _odds(self, side: dict, contexts: list, base: float) -> float:
        p = base
        for c in contexts[1:]:
            seen = side.get(c)
            if seen:
                p = (seen[0] + 4.0 * p) / (seen[1] + 4.0)
        p = min(max(p, 1e-4), 1 - 1e-4)
        return log(p / (1 - p)) - log(base / (1 - base))

    def long(self, text: str) -> bool:
        """Whether a text has more units than any sentence of the collection and half as many again."""
        if _WIDE.search(text) is None:
            longest = self.longest[False]
            return 0 < longest < (len(text) + 1) // 2 and len(text.split()) > longest  # words have blanks between them
        n = len(_SIGN.findall(text))
        return 0 < self.longest[2 * len(_WIDE.findall(text)) > n] < n

    def cuts(self, text: str) -> list[int]:
        """Ends of the sentences within a text without marks."""
        if not self.long(text):
            return []
        wide = self.wide(text)
        spans = _units(text)
        n, longest = len(spans), self.longest[wide]
        bases = []
        for side in (self.left, self.right):
            seen = side.get(0, (1.0, 10.0))
            bases.append(min(max(seen[0] / max(seen[1], 1.0), 1e-3), 0.5))
        gain = np.zeros(n + 1)
        level = not wide and (text.islower() or text.isupper())  # then case tells nothing
        known = self.known
        if len(known) > _REMEMBERED:
            known.clear()
        for i in range(1, n):
            a, b = spans[i - 1]
            key = (text[max(0, a - 2) : b] if b - a == 1 else text[a:b], level, 0)
            if (left := known.get(key)) is None:
                left = known[key] = self._odds(self.left, self._before(text, spans, i - 1, level), bases[0])
            a, b = spans[i]
            key = (text[a : b + 2] if b - a == 1 else text[a:b], level, 1)
            if (right := known.get(key)) is None:
                right = known[key] = self._odds(self.right, self._after(text, spans, i, level), bases[1])
            gain[i] = left + right
        # Every way to cut: a sentence of k words has the weight of its length, one beyond the longest a constant.
        prior = np.exp(self.prior[wide])
        far = float(prior.min())
        backwards = prior[:0:-1]  # weights of the lengths longest .. 1

        def swept(worth: list[float]) -> np.ndarray:
            """Logarithms of the weight of all ways to cut up to each place. The sums are rescaled before they leave the range of a number."""
            total = np.zeros(n + 1)
            total[0] = 1.0
            logs = np.zeros(n + 1)
            shift, beyond = 0.0, 0.0  # beyond: ways whose last event lies further back than the longest
            for i in range(1, n + 1):
                low = i - longest
                if low > 0:
                    beyond += total[low - 1]
                    value = float(total[low:i] @ backwards)
                else:
                    value = float(total[:i] @ backwards[-i:])
                value = (value + beyond * far) * worth[i]
                total[i] = value
                logs[i] = log(value) + shift
                if not 1e-60 < value < 1e60:
                    total[max(0, low) : i + 1] /= value
                    beyond /= value
                    shift += log(value)
            return logs

        worth = np.exp(gain).tolist()
        forward = swept(worth)
        backward = swept(worth[::-1])[::-1]
        posterior = np.exp(np.minimum(forward + backward - gain - forward[n], 0.0))
        return [spans[i - 1][1] for i in range(1, n) if posterior[i] > 0.5]


_WIDE = re.compile(f"[{_HAN}{_THAI}]")
_TERMINAL = re.compile(rf"[{_FULL}]|[{_END}](?=[\s{_CLOSE}])")  # no decimal points


def _ranges(text: str, cuts: list[int]) -> list[tuple[int, int]]:
    out = []
    for a, b in zip([0, *cuts], [*cuts, len(text)]):
        piece = text[a:b].rstrip()
        inner = piece.lstrip()
        if inner:
            end = a + len(piece)
            out.append((end - len(inner), end))
    return out


def judged(text: str, model: EventModel) -> list[int]:
    """Ends of the sentences within a paragraph, as far as they are told by marks."""
    row = gaps(text)
    return [g.end for g, p in zip(row, model.posteriors(row)) if p > 0.5]


def split(text: str, model: EventModel) -> list[tuple[int, int]]:
    """The sentences of a paragraph as ranges of code points."""
    return finer(text, judged(text, model), model.bare)


def finer(text: str, ends: list[int], bare: Bare | None) -> list[tuple[int, int]]:
    """The sentences of a paragraph whose ends at marks are judged: stretches without marks are cut too."""
    out = _ranges(text, ends)
    if bare is None or all(b - a <= bare.shortest for a, b in out):
        return out
    fine = []
    for a, b in out:
        # Marks inside, such as those of a quotation, tell that the model has judged them.
        inside = text[a:b] if b - a > bare.shortest else ""
        cuts = bare.cuts(inside) if inside and bare.long(inside) and _TERMINAL.search(inside.rstrip(_MARKS_AND_BLANK)) is None else []
        fine += [(a + x, a + y) for x, y in _ranges(inside, cuts)] if cuts else [(a, b)]
    return fine


def drawn(rows: DataFrame, sample: int) -> list:
    """About ``sample`` distinct rows, all if there are fewer: those whose hash lies below a share of its range. The driver sees no more.

    They come in the order of their hashes, so that any first part of them is a fair draw too.
    """
    hashed = rows.withColumn("drawn_at", F.xxhash64(*rows.columns))
    share = min(1.0, sample / max(1, hashed.select("drawn_at").distinct().count()))
    kept = hashed.where(F.pmod("drawn_at", F.lit(1 << 30)) < int(share * (1 << 30))).dropDuplicates()
    return [tuple(r)[:-1] for r in sorted(kept.collect(), key=lambda r: (r["drawn_at"], str(r)))]


_COUNTED = "kind string, key string, one bigint, two bigint, three bigint"
_ENDS = "char_ends"


def _counted(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int64())
    columns = zip(*rows) if rows else ((),) * 5
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], ["kind", "key", "one", "two", "three"])


def _observing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    words, ends, seen, rows = Counter(), Counter(), Counter(), Counter()

    def told() -> pa.RecordBatch:
        out = [("word", w, words[w], ends[w], seen[w]) for w in words.keys() | seen.keys()] + [(kind, key, n, 0, 0) for (kind, key), n in rows.items()]
        for held in (words, ends, seen, rows):
            held.clear()
        return _counted(out)

    for batch in batches:
        for text in batch.column(0).to_pylist():
            observed(text, words, ends, seen, rows)
            if len(words) + len(rows) > _HELD:
                yield told()
    yield told()


def _reducing(shared):
    def reduce(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        guess = shared.value
        fresh, held = EventModel(guess.vocabulary), Counter()
        for batch in batches:
            for kind, key, n in zip(*(batch.column(i).to_pylist() for i in range(3))):
                held[kind, guess.reduced(kind, key, fresh)] += n
            if len(held) > _HELD:
                yield _counted([(*k, n, 0, 0) for k, n in held.items()])
                held.clear()
        yield _counted([(*k, n, 0, 0) for k, n in held.items()])

    return reduce


def _expecting(shared, paired: bool):
    def expect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = Sums(shared.value, paired)
        for batch in batches:
            for kind, key, n in zip(*(batch.column(i).to_pylist() for i in range(3))):
                sums.add(kind, key, n)
            if len(sums) > _HELD:
                yield _counted([(*k, *v, 0) for k, v in sums.told().items()])
                sums.clear()
        yield _counted([(*k, *v, 0) for k, v in sums.told().items()])

    return expect


def _judging(shared):
    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            ends = [judged(text, model) for text in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ends, pa.list_(pa.int32()))], ["text", _ENDS])

    return judge


def _learning(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    bare = Bare()
    for batch in batches:
        for text, ends in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            bare.learn(text, _ranges(text, ends))
            if sum(map(len, bare.units.values())) > _HELD:
                bare.told()
                yield _counted(bare.rows())
                bare = Bare()
    bare.told()
    yield _counted(bare.rows())


def fit(paragraphs: DataFrame) -> EventModel:
    """A model fitted on all distinct paragraphs of the collection."""
    return _fitted(paragraphs)[0]


def _fitted(paragraphs: DataFrame) -> tuple[EventModel, DataFrame]:
    """The model, and the distinct paragraphs with the ends it judges: (text, char_ends).

    One pass counts tokens and chains of gaps; the rounds go over the distinct chains only, reduced to what the model tells apart; then
    every paragraph is judged, and the sentences found are counted. The driver sees the words that count by themselves and the contexts of the model.
    """
    context = paragraphs.sparkSession.sparkContext
    texts = written(paragraphs.where(F.trim("text") != "").select("text").dropDuplicates())

    def summed(rows: DataFrame) -> DataFrame:
        return rows.groupBy("kind", "key").agg(*(F.sum(c).alias(c) for c in ("one", "two", "three")))

    def brought(rows: DataFrame) -> Iterator[tuple]:
        table = rows.toArrow()
        return zip(*(table.column(i).to_pylist() for i in range(5)))

    counts = written(summed(texts.mapInArrow(_observing, _COUNTED)))
    tokens = list(brought(counts.where("kind = 'word' and (one >= 6 or three >= 8)")))
    total = F.sum(F.when(F.col("kind") == "chain", F.col("one") * F.size(F.split("key", _ELEMENT))))
    gapped, many = counts.agg(total, F.sum(F.when(F.col("kind") == "start", F.col("one")))).first()
    guess = Guess({w: n for _, w, n, _, _ in tokens}, {w: n for _, w, _, n, _ in tokens}, {w: n for _, w, _, _, n in tokens}, gapped or 0, many or 0)
    # Dealt out evenly: few bytes, much work.
    reduced = written(summed(counts.where("kind != 'word'").mapInArrow(_reducing(context.broadcast(guess)), _COUNTED)).repartition(2 * context.defaultParallelism))
    model = None
    for k in range(_ROUNDS):
        shared = context.broadcast(model)
        told = summed(reduced.mapInArrow(_expecting(shared, k == _ROUNDS - 1), _COUNTED)).where(f"kind != 'pair' or two >= {_PAIRED}")
        model = _model(guess.vocabulary, {(kind, key): (one, two) for kind, key, one, two, _ in brought(told)})
        shared.destroy()
    shared = context.broadcast(model)
    found = written(texts.mapInArrow(_judging(shared), f"text string, {_ENDS} array<int>"))
    shared.destroy()
    bare = Bare()
    bare.gather(brought(summed(found.mapInArrow(_learning, _COUNTED)).where("two >= 2 or key = '' or kind like 'length%'")))
    bare.settle()
    model.bare = bare
    return model, found


def _splitting(shared, keys: int, cut):
    """``cut`` takes what is shared after the columns behind the keys."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = shared.value
        for batch in batches:
            owner, start, end = [], [], []
            for k, row in enumerate(zip(*(batch.column(i).to_pylist() for i in range(keys, batch.num_columns)))):
                for a, b in cut(*row, held):
                    owner.append(k)
                    start.append(a)
                    end.append(b)
            at = pa.array(np.array(owner, np.int64))
            kept = [batch.column(i).take(at) for i in range(keys)]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(start, pa.int64()), pa.array(end, pa.int64())], [*batch.schema.names[:keys], "char_start", "char_end"])

    return rows


def sentence_ranges(paragraphs: DataFrame, keys: list[str], model: EventModel | None = None) -> DataFrame:
    """(keys..., char_start, char_end): one row for each sentence of each distinct (keys, text)."""
    broadcast = paragraphs.sparkSession.sparkContext.broadcast
    once = paragraphs.where(F.trim("text") != "").select(*keys, "text")
    if model is None:
        # Equal texts were judged once, for the model; dealt out by text, they also meet their copies.
        fitted, found = _fitted(paragraphs)
        once = once.repartition("text").dropDuplicates().join(found, "text").select(*keys, "text", _ENDS)
        cut = _splitting(broadcast(fitted.bare), len(keys), finer)
    else:
        cut = _splitting(broadcast(model), len(keys), split)
        once = once.dropDuplicates()
    schema = ", ".join(f"`{k}` {paragraphs.schema[k].dataType.simpleString()}" for k in keys)
    return once.mapInArrow(cut, f"{schema}, char_start bigint, char_end bigint")
