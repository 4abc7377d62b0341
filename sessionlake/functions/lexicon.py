"""Words of unbroken scripts: the most probable path through the graph of a lexicon's words, and words that the lexicon lacks.

A run's graph has an edge for each word that starts at a place, found by walking a prefix trie, and one for each single character. A word costs the logarithm of its share of the
lexicon's counts; the cheapest path is found from the end backwards, of equals the one with the longer word first. Single characters that follow each other on the path may be a word that the
lexicon lacks: a hidden Markov model of places in a word (begin, middle, end, single) cuts them anew by Viterbi. Its chances are those of the lexicon's own words, so nothing
but the lexicon is needed.

Cases: an empty lexicon leaves single characters; a count below 1 is 1; runs of any length take time in proportion.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator, Mapping
from functools import lru_cache

BITS = 21  # of a code point
BEGIN, MIDDLE, END, SINGLE = range(4)
#: What may stand before a place in a word.
BEFORE = {BEGIN: (END, SINGLE), MIDDLE: (BEGIN, MIDDLE), END: (BEGIN, MIDDLE), SINGLE: (END, SINGLE)}


class Lexicon:
    def __init__(self, words: Mapping[str, int] | Iterable[str] = ()):
        counts = dict(words) if isinstance(words, Mapping) else dict.fromkeys(words, 1)
        self.counts = {w: max(1, int(n)) for w, n in counts.items() if w}
        self.total = sum(self.counts.values())
        self.step: dict[int, int] = {}
        self.count = [0]
        for w, n in self.counts.items():
            node = 0
            for c in w:
                key = node << BITS | ord(c)
                if key not in self.step:
                    self.step[key] = len(self.count)
                    self.count.append(0)
                node = self.step[key]
            self.count[node] = n
        self._train()

    def _train(self) -> None:
        """Chances of places in a word from the lexicon's words, each as often as it counts; half a character is added for each that wasn't seen."""
        seen = [dict() for _ in range(4)]
        moves = [[0.5] * 4 for _ in range(4)]
        several, single = 1.0, 1.0
        for w, n in self.counts.items():
            places = [SINGLE] if len(w) == 1 else [BEGIN, *[MIDDLE] * (len(w) - 2), END]
            for c, p in zip(w, places, strict=True):
                seen[p][c] = seen[p].get(c, 0) + n
            for a, b in zip(places, places[1:], strict=False):
                moves[a][b] += n
            several, single = (several, single + n) if len(w) == 1 else (several + n, single)
        for a in (END, SINGLE):
            moves[a][BEGIN], moves[a][SINGLE] = several, single
        known = len({c for s in seen for c in s}) + 1
        self.seen = [{c: math.log((n + 0.5) / (sum(s.values()) + 0.5 * known)) for c, n in s.items()} for s in seen]
        self.unseen = [math.log(0.5 / (sum(s.values()) + 0.5 * known)) for s in seen]
        self.start = {BEGIN: math.log(several / (several + single)), SINGLE: math.log(single / (several + single))}
        self.move = {b: {a: math.log(moves[a][b] / sum(moves[a][x] for x in range(4) if a in BEFORE[x])) for a in BEFORE[b]} for b in range(4)}

    def __contains__(self, word: str) -> bool:
        return word in self.counts

    def ends(self, run: str, start: int) -> Iterator[tuple[int, int]]:
        """(end, count) of the words that start at a place."""
        node, step = 0, self.step
        for i in range(start, len(run)):
            node = step.get(node << BITS | ord(run[i]), -1)
            if node < 0:
                return
            if self.count[node]:
                yield i + 1, self.count[node]

    def cost(self, count: int) -> float:
        """Of a word; what isn't in the lexicon counts as one."""
        return math.log(max(self.total, 1)) - math.log(max(count, 1))

    def path(self, run: str) -> list[tuple[int, int]]:
        """(start, end) of the words of the most probable path."""
        n = len(run)
        best, after = [0.0] * (n + 1), [0] * n
        for i in range(n - 1, -1, -1):
            edges = dict(self.ends(run, i))
            edges.setdefault(i + 1, 0)
            best[i], back = min((best[j] + self.cost(k), -j) for j, k in edges.items())
            after[i] = -back
        out, i = [], 0
        while i < n:
            out.append((i, after[i]))
            i = after[i]
        return out

    def discover(self, run: str) -> list[tuple[int, int]]:
        """(start, end) of the words of a run by places alone, the most probable ones."""
        chance = lambda p, c: self.seen[p].get(c, self.unseen[p])
        score = {p: self.start.get(p, -math.inf) + chance(p, run[0]) for p in range(4)}
        back: list[dict[int, int]] = []
        for c in run[1:]:
            came = {p: max(BEFORE[p], key=lambda a, p=p: score[a] + self.move[p][a]) for p in range(4)}
            score = {p: score[a] + self.move[p][a] + chance(p, c) for p, a in came.items()}
            back.append(came)
        place = max((END, SINGLE), key=score.__getitem__)
        places = [place]
        for came in reversed(back):
            place = came[place]
            places.append(place)
        places.reverse()
        out, start = [], 0
        for i, p in enumerate(places):
            if p in (END, SINGLE):
                out.append((start, i + 1))
                start = i + 1
        return out

    def cut(self, run: str) -> list[tuple[int, int]]:
        """(start, end) of a run's words: those of the path, with its single characters cut anew where several follow each other."""
        out: list[tuple[int, int]] = []
        singles: list[tuple[int, int]] = []

        def flush() -> None:
            if len(singles) > 1 and self.counts and run[singles[0][0] : singles[-1][1]] not in self:
                base = singles[0][0]
                out.extend((base + a, base + z) for a, z in self.discover(run[base : singles[-1][1]]))
            else:
                out.extend(singles)
            singles.clear()

        for a, z in self.path(run):
            if z == a + 1:
                singles.append((a, z))
            else:
                flush()
                out.append((a, z))
        flush()
        return out


def parsed(lines: Iterable[str]) -> dict[str, int]:
    """A word list: a word a line, with its count behind it if there is one (further columns are not read)."""
    out = {}
    for line in lines:
        if parts := line.split():
            out[parts[0]] = int(float(parts[1])) if len(parts) > 1 and parts[1].replace(".", "", 1).isdigit() else 1
    return out


@lru_cache(maxsize=4)
def loaded(path: str) -> Lexicon:
    """The lexicon of a file, once for each process."""
    with open(path, encoding="utf-8") as f:
        return Lexicon(parsed(f))
