"""Operators written again, plainly, for small tables."""

from __future__ import annotations

import hashlib
import re

KINDS = ["assign", "access", "hex", "identifier", "secret", "endpoint"]


def secret_row(doc_id, text):
    t = text or ""
    found = []
    for m in re.finditer(r"([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", t):
        if len(m[2]) >= 6:
            found.append(("assign", m.start(), m.end()))
    found += [("access", m.start(), m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", t) if len(m[0]) >= 20]
    found += [("hex", m.start(), m.end()) for m in re.finditer(r"[0-9a-f]+", t) if len(m[0]) >= 24]
    base = list(found)
    weak = [("identifier", m.start(), m.end()) for m in re.finditer(r"[A-Z0-9]{16,}", t) if re.search("[A-Z]", m[0]) and re.search("[0-9]", m[0]) and not m[0].startswith("AKIA")]
    weak += [("secret", m.start(), m.end()) for m in re.finditer(r"[A-Za-z0-9+/_=-]{24,}", t) if all(re.search(c, m[0]) for c in ("[A-Z]", "[a-z]", "[0-9]"))]
    weak += [("endpoint", m.start(), m.end()) for m in re.finditer(r"(?:[a-z][a-z0-9+.-]{0,31}://[A-Za-z0-9._~:@/?&=%-]+|[0-9]{1,3}(?:\.[0-9]{1,3}){3}:[0-9]{2,5}|[A-Za-z0-9-]{1,63}(?:\.[A-Za-z0-9-]{1,63}){1,8}:[0-9]{2,5})", t)]
    partners = {"identifier": {"secret", "assign", "hex"}, "secret": {"identifier", "endpoint", "access"}, "endpoint": {"secret", "assign", "hex"}}
    gate = re.search(r"AKIA[A-Z0-9]{16}|[0-9a-f]{24}|[A-Z0-9]{16}|[A-Za-z0-9+/_=-]{24}", t) or base
    for k, s, e in weak if gate else []:
        others = [(k2, s2, e2) for k2, s2, e2 in base + weak if s2 <= e + 200 and e2 >= s - 200]
        apart = lambda o: o[1] >= e or o[2] <= s
        if any(apart(o) and o[0] in partners[k] for o in others) and not any(not apart(o) and o[0] in KINDS[:3] for o in others):
            found.append((k, s, e))
    told = lambda items: ",".join(f"{k}:{s}:{e}" for k, s, e in sorted(items, key=lambda x: (x[1], KINDS.index(x[0]))))
    counts = [sum(k == name for k, _, _ in base) for name in KINDS[:3]]
    return (doc_id, *counts, hashlib.sha256(told(base).encode()).hexdigest(), told(found))
