"""Many strings searched at once: an automaton with failure links in flat arrays, run over many texts in step; word lists as sorted numbers."""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np

#: Bits of a character in an edge's key, and characters of a text that are run in one lane.
CHAR_BITS, LANE = 21, 512
_TIMES = np.uint64(0x9E3779B97F4A7C15)


class _Edges:
    """Edge keys to states by open addressing."""

    def __init__(self, keys: np.ndarray, states: np.ndarray):
        bits = max(4, int(2 * len(keys)).bit_length())
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.keys, self.states = np.full(1 << bits, -1, np.int64), np.zeros(1 << bits, np.int32)
        at, todo = self._slot(keys), np.arange(len(keys))
        while len(todo):
            free = np.nonzero(self.keys[at] == -1)[0]
            slot, first = np.unique(at[free], return_index=True)
            put = todo[free[first]]
            self.keys[slot], self.states[slot] = keys[put], states[put]
            left = np.ones(len(todo), bool)
            left[free[first]] = False
            todo, at = todo[left], (at[left] + 1) & self.mask

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return (keys.astype(np.uint64) * _TIMES >> self.shift).astype(np.int64)

    def get(self, keys: np.ndarray) -> np.ndarray:
        """The state that each edge leads to, -1 where there is no such edge."""
        out, at, todo = np.full(len(keys), -1, np.int32), self._slot(keys), np.arange(len(keys))
        while len(todo):
            seen = self.keys[at]
            hit = seen == keys[todo]
            out[todo[hit]] = self.states[at[hit]]
            on = ~hit & (seen != -1)
            todo, at = todo[on], (at[on] + 1) & self.mask
        return out


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64)


class Automaton:
    """States of all prefixes of the words, by depth; a state's failure link is that of its longest end that is a prefix too, ``link`` the next of these that ends a word."""

    def __init__(self, words: Iterable[str]):
        self.words = sorted({w for w in words if w})
        sizes = np.array([len(w) for w in self.words], np.int64)
        chars, starts = code_points("".join(self.words)), np.cumsum(sizes) - sizes
        self.longest = int(sizes.max(initial=0))
        node, keys, levels, n = np.zeros(len(sizes), np.int64), [], [], 1
        ends: list[tuple[np.ndarray, np.ndarray]] = []
        for depth in range(self.longest):
            some = np.nonzero(sizes > depth)[0]
            edge, which = np.unique(node[some] << CHAR_BITS | chars[starts[some] + depth], return_inverse=True)
            node[some] = n + which
            keys.append(edge)
            levels.append((n, n + len(edge)))
            n += len(edge)
            last = some[sizes[some] == depth + 1]
            ends.append((node[last], last))
        self.n = n
        every = np.concatenate([np.zeros(0, np.int64), *keys])
        self.edges = _Edges(every, np.arange(1, n, dtype=np.int32))
        self.word = np.full(n, -1, np.int32)
        for states, which in ends:
            self.word[states] = which
        self.fail, self.link = np.zeros(n, np.int32), np.full(n, -1, np.int32)
        for low, high in levels[1:]:
            parent, char = every[low - 1 : high - 1] >> CHAR_BITS, every[low - 1 : high - 1] & ((1 << CHAR_BITS) - 1)
            to = self._step(self.fail[parent].astype(np.int64), char)
            self.fail[low:high] = to
            self.link[low:high] = np.where(self.word[to] >= 0, to, self.link[to])
        self.tells = (self.word >= 0) | (self.link >= 0)

    def _step(self, state: np.ndarray, char: np.ndarray) -> np.ndarray:
        """The states after one more character each."""
        out, todo, here = np.zeros(len(state), np.int32), np.arange(len(state)), state
        while len(todo):
            to = self.edges.get(here << CHAR_BITS | char[todo])
            out[todo] = np.maximum(to, 0)
            back = (to < 0) & (here > 0)
            todo, here = todo[back], self.fail[here[back]].astype(np.int64)
        return out

    def find(self, texts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(text, place, word) of all occurrences in texts of code points, overlapping ones too; place is the first character's.

        Texts are cut into lanes, each begun early enough for words that reach into it.
        """
        none = np.zeros(0, np.int64)
        lanes = [(t, at) for t, x in enumerate(texts) for at in range(0, len(x), LANE)]
        if not lanes or not self.words:
            return none, none, none
        text, at = np.array(lanes, np.int64).T
        size = np.array([len(x) for x in texts], np.int64)
        base = np.cumsum(size) - size
        early = np.minimum(at, self.longest - 1)
        steps = early + np.minimum(LANE, size[text] - at)
        order = np.argsort(-steps, kind="stable")
        text, at, early, steps = text[order], at[order], early[order], steps[order]
        chars, first = np.concatenate(texts), (base[text] + at - early)
        state, seen = np.zeros(len(text), np.int64), []
        for k in range(int(steps[0])):
            live = int(np.searchsorted(-steps, -k, "left"))  # lanes with more than k steps
            state = self._step(state[:live], chars[first[:live] + k]).astype(np.int64)
            hit = np.nonzero(self.tells[state] & (k >= early[:live]))[0]
            if len(hit):
                seen.append((hit, np.full(len(hit), k), state[hit]))
        if not seen:
            return none, none, none
        lane, k, states = (np.concatenate(c) for c in zip(*seen))
        found = []
        while len(lane):
            word = self.word[states]
            own = word >= 0
            end = at[lane[own]] - early[lane[own]] + k[own]
            found.append((text[lane[own]], end, word[own].astype(np.int64)))
            on = self.link[states] >= 0
            lane, k, states = lane[on], k[on], self.link[states[on]].astype(np.int64)
        got, end, word = (np.concatenate(c) for c in zip(*found))
        length = np.array([len(w) for w in self.words], np.int64)
        return got, end - length[word] + 1, word


class WordList:
    """Words of 4 to 12 letters or digits as sorted numbers, by length: eight bytes a word, however many there are."""

    LENGTHS = range(4, 13)
    _DIGIT = np.full(128, -1, np.int64)
    _DIGIT[[ord(c) for c in "0123456789abcdefghijklmnopqrstuvwxyz"]] = np.arange(36)

    def __init__(self, numbers: dict[int, np.ndarray]):
        self.numbers = {n: np.unique(np.asarray(v, np.int64)) for n, v in numbers.items() if len(v)}

    @classmethod
    def of(cls, words: Iterable[str]) -> WordList:
        by: dict[int, list[int]] = {}
        for w in words:
            if len(w) in cls.LENGTHS and w.isascii() and w.isalnum():
                by.setdefault(len(w), []).append(int(w.lower(), 36))
        return cls({n: np.array(v, np.int64) for n, v in by.items()})

    @classmethod
    def of_table(cls, words, column: str) -> WordList:
        """From a table of words of any number: Spark turns them into distinct numbers, and only these reach the driver."""
        from pyspark.sql import functions as F

        w = F.lower(F.col(column))
        usable = words.where(w.rlike("^[a-z0-9]{4,12}$")).select(F.length(w).alias("n"), F.conv(w, 36, 10).cast("long").alias("number")).distinct()
        got = usable.toArrow()
        n, number = got["n"].to_numpy(), got["number"].to_numpy()
        return cls({int(k): number[n == k] for k in np.unique(n)})

    def __len__(self) -> int:
        return sum(map(len, self.numbers.values()))

    def tiles(self, text: str) -> list[tuple[int, np.ndarray]]:
        """(length, whether a word of it begins there, by place) over a text of lower-case letters and digits."""
        digits = self._DIGIT[np.frombuffer(text.encode("ascii"), np.uint8)]
        out, number = [], digits
        for n in range(2, min(self.LENGTHS.stop, len(text) + 1)):
            number = number[:-1] * 36 + digits[n - 1 :]
            known = self.numbers.get(n)
            if known is not None:
                at = np.minimum(np.searchsorted(known, number), len(known) - 1)
                out.append((n, known[at] == number))
        return out

    def coverage(self, text: str) -> float:
        """Largest share of letters that words can tile without overlapping."""
        if len(text) < 8 or not self.numbers:
            return 0.0
        ends: dict[int, list[int]] = {}
        for n, there in self.tiles(text):
            for at in np.nonzero(there)[0].tolist():
                ends.setdefault(at + n, []).append(n)
        best = [0] * (len(text) + 1)
        done = 0
        for end in sorted(ends):  # between two ends of words nothing changes
            for k in range(done + 1, end + 1):
                best[k] = best[done]
            best[end] = max([best[end], *(best[end - n] + n for n in ends[end])])
            done = end
        return best[done] / len(text)
