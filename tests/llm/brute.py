"""Plain versions of the operators, for small tables."""

import hashlib
import re
from collections import Counter


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def fold(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def components(ids, linked):
    parent = {i: i for i in ids}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in linked:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    return {i: root(i) for i in ids}


def shingles(text):
    w = words(fold(text))
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def near(rows):
    sets = {i: shingles(t) for i, t, _ in rows if i is not None}
    ids = sorted(sets)
    linked = [
        (a, b) for a in ids for b in ids
        if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])
    ]
    return sets, components(ids, linked)


def base_figures(text):
    w = words(text)
    windows = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    count = Counter(windows)
    repeated = {j for i, x in enumerate(windows) if count[x] > 1 for j in range(i, i + 3)}
    lines = [x for x in (text or "").split("\n") if words(x)]
    return {
        "n_words": len(w),
        "word_chars": sum(map(len, w)),
        "n_symbols": len(re.findall(r"[#*$%&|<>]", text or "")),
        "n_dup_lines": len(lines) - len(set(lines)),
        "n_repeat_words": len(repeated),
        "base_failed": len(w) < 50 or 100 * len(repeated) > 50 * len(w),
    }


def frequent(rows, least=20, percent=10):
    by_host: dict = {}
    for _, t, s in rows:
        by_host.setdefault(s or "", set()).add(t or "")
    out = {}
    for host, texts in by_host.items():
        count = Counter(x for t in texts for x in {" ".join(words(fold(line))) for line in t.split("\n")} if x)
        out[host] = {x for x, n in count.items() if n > least and 100 * n > percent * len(texts)}
    return out


def quality(rows, least=20, percent=10):
    """(id, text or None if rejected, removed words) of each row."""
    lines = frequent(rows, least, percent)
    out = []
    for i, t, s in rows:
        own = lines[s or ""]
        kept = [x for x in (t or "").split("\n") if not words(x) or " ".join(words(fold(x))) not in own]
        left = "\n".join(kept)
        n, k = len(words(t)), len(words(left))
        good = not base_figures(t)["base_failed"] and 100 * k >= 50 * n
        out.append((i, left if good else None, n - k))
    return out


def similar_lines(rows, percent=85, least=5):
    """Removed line numbers by doc_id."""
    seen, out = [], {}
    for i, t in sorted({(i, t or "") for i, t, _ in rows if i is not None}):
        for k, line in enumerate(t.split("\n")):
            own = set(words(fold(line)))
            if len(own) < least:
                continue
            if any(100 * len(own & s) >= percent * len(own | s) for s in seen):
                out.setdefault(i, []).append(k)
            seen.append(own)
    return out


def substrings(rows, window=20):
    """(n_words, n_removed, sha256) by doc_id."""
    seen, out = set(), {}
    for i, t in sorted({(i, t or "") for i, t, _ in rows}, key=lambda x: (x[0] is not None, x[0] or 0, x[1])):
        w = words(t)
        gone = set()
        for k in range(len(w) - window + 1):
            x = tuple(w[k : k + window])
            if x in seen:
                gone |= set(range(k, k + window))
            seen.add(x)
        kept = " ".join(x for k, x in enumerate(w) if k not in gone)
        out[i] = len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()
    return out


def distance_in(item, text):
    """Least word edits from ``item`` to any run of words of ``text``."""
    row = [0] * (len(text) + 1)
    for i, word in enumerate(item, 1):
        new = [i]
        for j, other in enumerate(text, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (word != other)))
        row = new
    return min(row)


def spans(text):
    """Secrets of the base patterns: (kind, start, end)."""
    rules = [
        ("assign", r"""((?ai:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", lambda m: len(m[2]) >= 6),
        ("access", r"AKIA[A-Z0-9]+", lambda m: len(m[0]) >= 20),
        ("hex", r"[0-9a-f]+", lambda m: len(m[0]) >= 24),
    ]
    found = [(m.start(), n, k, m.end()) for n, (k, p, ok) in enumerate(rules) for m in re.finditer(p, text) if ok(m)]
    return [(k, a, b) for a, _, k, b in sorted(found)]
