"""Which words of a sentence stand in its evidence in the same order: runs found by a suffix automaton."""

from __future__ import annotations


class SuffixAutomaton:
    """All runs of consecutive words of some texts, in space and time linear in them."""

    def __init__(self, words: list[str] | tuple[str, ...] = ()):
        self.next: list[dict[str, int]] = [{}]
        self.link, self.size = [-1], [0]
        self.add(words)

    def add(self, words: list[str] | tuple[str, ...]) -> None:
        """Take in one more text; no run goes on from one text to another."""
        last = 0
        for word in words:
            known = self.next[last].get(word)
            if known is not None:  # an earlier text says the same up to here
                last = self._own(last, word, known)
                continue
            now = self._state({}, self.size[last] + 1, 0)
            at = last
            while at >= 0 and word not in self.next[at]:
                self.next[at][word] = now
                at = self.link[at]
            if at >= 0:
                self.link[now] = self._own(at, word, self.next[at][word])
            last = now

    def _own(self, at: int, word: str, target: int) -> int:
        """The state of the runs of ``at`` with ``word`` after them, no longer ones among them."""
        if self.size[target] == self.size[at] + 1:
            return target
        copy = self._state(dict(self.next[target]), self.size[at] + 1, self.link[target])  # longer runs end there too: a state of its own for the short ones
        while at >= 0 and self.next[at].get(word) == target:
            self.next[at][word] = copy
            at = self.link[at]
        self.link[target] = copy
        return copy

    def _state(self, after: dict[str, int], size: int, link: int) -> int:
        self.next.append(after)
        self.size.append(size)
        self.link.append(link)
        return len(self.next) - 1

    def matched(self, words: list[str]) -> list[int]:
        """For each word, how many words up to and including it are a run of the text."""
        out, at, length = [], 0, 0
        for word in words:
            while at and word not in self.next[at]:
                at = self.link[at]
                length = self.size[at]
            if word in self.next[at]:
                at, length = self.next[at][word], length + 1
            out.append(length)
        return out


def runs(automaton: SuffixAutomaton, words: list[str], least: int) -> tuple[list[tuple[int, int]], int]:
    """(start and end of each stretch that runs of at least ``least`` words cover, the longest run of all)."""
    lengths, found = automaton.matched(words), []
    for end, length in enumerate(lengths, 1):
        if length >= least:
            start = end - length
            if found and start <= found[-1][1]:
                start = found.pop()[0]
            found.append((start, end))
    return found, max(lengths, default=0)


def supported(automaton: SuffixAutomaton, words: list[str], least: int) -> tuple[int, int]:
    """(words within runs of at least ``least`` that the text has, the longest run of all)."""
    found, longest = runs(automaton, words, least)
    return sum(end - start for start, end in found), longest
