"""URL rules and models again, plainly."""

from __future__ import annotations

import math
from collections import Counter

RULES = [("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/")]


def split(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    n = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
    host, tail = rest[:n], rest[n:]
    m = min([tail.find(c) for c in "?#" if c in tail], default=len(tail))
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host), tail[:m]


def rule_of(host, path):
    best = (None, None)
    for verdict, rule in sorted(RULES, key=lambda r: len(r[1])):
        h, p = rule.split("/", 1)
        if (host == h or host.endswith("." + h)) and path.startswith("/" + p):
            best = (rule, verdict)
    return best


class Model:
    def __init__(self, texts, order=6):
        self.order, self.grams = order, [Counter() for _ in range(order + 1)]
        for text, n in texts:
            s = "\x02" * (order - 1) + text + "\x03"
            for i in range(order - 1, len(s)):
                for k in range(1, order + 1):
                    self.grams[k][s[i - k + 1 : i + 1]] += n
        self.all, self.new = Counter(), Counter()
        for k in range(1, order + 1):
            for g, c in self.grams[k].items():
                self.all[g[:-1], k] += c
                self.new[g[:-1], k] += 1

    def log(self, window):
        p = 1 / 256
        for k in range(1, self.order + 1):
            g = window[-k:]
            if total := self.all[g[:-1], k]:
                new = self.new[g[:-1], k]
                p = (self.grams[k][g] + new * p) / (total + new)
        return math.log(p)


def score(text, allowed, blocked, order=6):
    s = "\x02" * (order - 1) + text + "\x03"
    values = [round((allowed.log(s[i : i + order]) - blocked.log(s[i : i + order])) * 1e6) for i in range(len(s) - order + 1)]
    return sum(values) / len(values) / 1e6
