"""Many phrases found in one pass over a text's words.

The phrases form a trie of words.  A node's failure link leads to the longest
proper suffix of its words that also starts a phrase, its hit link to the
longest that is one, so a text is read once whatever the number and length of
the phrases, and every occurrence is found, overlapping ones included.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterable, Iterator


class WordAutomaton:
    """``find`` gives the numbers of the phrases at each place where they end;
    phrases without words are never found."""

    def __init__(self, phrases: Iterable[list[str]]):
        self.steps: list[dict[str, int]] = [{}]
        self.own: list[list[int]] = [[]]
        for number, words in enumerate(phrases):
            node = 0
            for word in words:
                if word not in self.steps[node]:
                    self.steps[node][word] = len(self.steps)
                    self.steps.append({})
                    self.own.append([])
                node = self.steps[node][word]
            if node:
                self.own[node].append(number)
        self.fail = [0] * len(self.steps)
        self.hit = [0] * len(self.steps)
        todo = deque(self.steps[0].values())
        while todo:
            node = todo.popleft()
            for word, child in self.steps[node].items():
                at = self.fail[node]
                while at and word not in self.steps[at]:
                    at = self.fail[at]
                at = self.steps[at].get(word, 0)
                self.fail[child] = at
                self.hit[child] = at if self.own[at] else self.hit[at]
                todo.append(child)

    def find(self, words: Iterable[str]) -> Iterator[int]:
        node = 0
        for word in words:
            while node and word not in self.steps[node]:
                node = self.fail[node]
            node = self.steps[node].get(word, 0)
            at = node if self.own[node] else self.hit[node]
            while at:
                yield from self.own[at]
                at = self.hit[at]
