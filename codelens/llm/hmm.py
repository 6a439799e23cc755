"""A hidden Markov model of characters: in which language, or in code, each character of a text is written.

States are code and the natural languages. A state gives a character by the two before it
(counts of three, two and one characters, interpolated; places in the tables by hash). Going
from one state to another costs the same for all, so a step of Viterbi's algorithm is a
maximum and a comparison. Texts of similar length take each step together."""

from __future__ import annotations

import numpy as np
import pandas as pd

STATES = ("code", "en", "zh", "de", "es", "fr", "ru", "ja")
TABLE = 1 << 16
WEIGHTS = (0.6, 0.3, 0.1)
FLOOR = 1e-7
#: Cost of a change of state, as a negative logarithm.
SWITCH = 7.0
#: Characters times texts that take their steps together.
TOGETHER = 1 << 22
#: What stands before a text, and a mark of its first character that is no character.
LINE_END, BEGIN = 10, (1 << 21) - 1
#: The first of the states that are in a set of eight bits, the first state's the highest.
BITS = np.array([[1 << len(STATES) - 1 - s] for s in range(len(STATES))], np.uint8)
FIRST = np.array([len(STATES) - max(bits, 1).bit_length() for bits in range(1 << len(STATES))], np.uint8)


def points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)


def places(c: np.ndarray, before: np.ndarray, before2: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each character: places of itself, of it and the one before, of it and the two before."""
    two = (c * 0x9E3779B1 + before * 0x85EBCA6B) & 0x7FFFFFFF
    three = (two * 0xC2B2AE35 + before2 * 0x27D4EB2F) & 0x7FFFFFFFFFFF
    return c & TABLE - 1, (two ^ two >> 15) & TABLE - 1, (three ^ three >> 21) & TABLE - 1


def over_states(of: np.ufunc, x: np.ndarray) -> np.ndarray:
    """A reduction of the rows, of which there are eight: by halves, as that goes over whole rows."""
    while len(x) > 1:
        x = of(x[: len(x) // 2], x[len(x) // 2 :])
    return x[0]


class Model:
    def __init__(self, samples: dict[str, list[str]]):
        """samples: texts of each state. A state without any is never taken."""
        n = len(STATES)
        self.one, self.two, self.three = (np.zeros((TABLE, n), np.float32) for _ in range(3))
        self.total = np.zeros(n, np.float32)
        for s, name in enumerate(STATES):
            text = points("".join(samples.get(name, ())))
            a, b, c = places(text, *(np.concatenate((np.full(k, LINE_END), text))[: len(text)] for k in (1, 2)))
            for table, at in ((self.one, a), (self.two, b), (self.three, c)):
                table[:, s] = np.bincount(at, minlength=TABLE)
            self.total[s] = len(a)
        self.unknown = self.total == 0

    def emissions(self, text: str) -> np.ndarray:
        """Logarithms, a row a character and a column a state."""
        codes, table = self.emitted([text])
        return table[codes]

    def emitted(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The texts' characters, one text after the other, as rows of a table of emissions.

        A character's emissions follow from it and the two before, so each three are reckoned once."""
        lengths = np.array([len(t) for t in texts], np.int64)
        c = points("".join(texts))
        begins = (np.cumsum(lengths) - lengths)[lengths > 0]
        seconds = (np.cumsum(lengths) - lengths)[lengths > 1] + 1
        before, before2 = np.roll(c, 1), np.roll(c, 2)
        before[begins], before2[begins], before2[seconds] = LINE_END, BEGIN, LINE_END
        codes, keys = pd.factorize(c << 42 | before << 21 | before2)
        return codes, self._reckoned(keys >> 42, keys >> 21 & BEGIN, keys & BEGIN)

    def _reckoned(self, c: np.ndarray, before: np.ndarray, before2: np.ndarray) -> np.ndarray:
        begin = before2 == BEGIN
        before2 = np.where(begin, LINE_END, before2)
        a, b, three = places(c, before, before2)
        # of what stands before, the tables that go with one and two characters; all of a state's characters where a text begins
        a1, b1, _ = places(before, before2, before2)
        first, second = (np.where(begin[:, None], self.total, x) for x in (self.one[a1], self.two[b1]))
        p = WEIGHTS[0] * self.three[three] / np.maximum(second, 1) + WEIGHTS[1] * self.two[b] / np.maximum(first, 1) + WEIGHTS[2] * self.one[a] / np.maximum(self.total, 1)
        e = np.log(p + FLOOR)
        e[:, self.unknown] = -1e6
        return e

    def likeliest(self, texts: list[str]) -> list[str]:
        """The state that would have written each text."""
        texts = [t or " " for t in texts]
        if not texts:
            return []
        begins = np.cumsum([0, *map(len, texts[:-1])])
        return [STATES[k] for k in np.add.reduceat(self.emissions("".join(texts)), begins, axis=0).argmax(1)]

    def states(self, texts: list[str]) -> list[np.ndarray]:
        """The likeliest states of each text's characters."""
        order = sorted(range(len(texts)), key=lambda i: len(texts[i]))
        out: list[np.ndarray] = [np.zeros(0, np.uint8)] * len(texts)
        k = 0
        while k < len(order):
            group = [order[k]]
            k += 1
            while k < len(order) and (len(group) + 1) * len(texts[order[k]]) <= TOGETHER:
                group.append(order[k])
                k += 1
            for i, s in zip(group, self._together([texts[i] for i in group])):
                out[i] = s
        return out

    def _together(self, texts: list[str]) -> list[np.ndarray]:
        """texts: by length, shortest first, so that those that go on at a step are the last ones."""
        lengths = np.array([len(t) for t in texts], np.int64)
        longest, n = int(lengths.max(initial=0)), len(texts)
        if not longest:
            return [np.zeros(0, np.uint8)] * n
        codes, table = self.emitted(texts)
        steps = np.zeros((longest, n), np.int32)
        text = np.repeat(np.arange(n), lengths)
        at = np.arange(len(codes)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
        steps[at, text] = codes
        live = np.searchsorted(lengths, np.arange(longest), "right").tolist()  # the first text that goes on
        changed = np.zeros((longest, n), np.uint8)  # the states to which the likeliest way came from another
        best = np.zeros((longest, n), np.uint8)  # the states that it may have come from
        score = np.ascontiguousarray(table[steps[0]].T)
        for t in range(1, longest):
            k = live[t]
            s = score[:, k:]
            top = over_states(np.maximum, s)
            other = top - np.float32(SWITCH)
            best[t, k:] = over_states(np.bitwise_or, (s == top).view(np.uint8) * BITS)
            changed[t, k:] = over_states(np.bitwise_or, (s < other).view(np.uint8) * BITS)
            np.maximum(s, other, out=s)
            s += table.take(steps[t, k:], axis=0).T
        best = FIRST[best]
        state = score.argmax(0).astype(np.uint8)
        path = np.zeros((longest, n), np.uint8)
        for t in range(longest - 1, -1, -1):
            k = live[t]
            s = state[k:]
            path[t, k:] = s
            np.copyto(s, best[t, k:], where=(changed[t, k:] & BITS[s, 0]) > 0)
        return [path[: lengths[i], i] for i in range(n)]


def fit(samples: dict[str, list[str]]) -> Model:
    """Labels may be wrong: a first model throws out the texts that another state would rather have written, a second is fitted on the rest."""
    first = Model(samples)
    return Model({name: [t for t, s in zip(texts, first.likeliest(texts)) if s == name] for name, texts in samples.items()})
