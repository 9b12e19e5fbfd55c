"""Plain re-statements of the operators' contracts for small inputs."""

import hashlib
import re


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text)


def space_words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def substring(rows, target=13):
    rows = [(d, space_words(t)) for d, t in rows]
    first = {}
    for d, w in rows:
        for i in range(len(w) - target + 1):
            key = tuple(w[i : i + target])
            if d is not None:
                first[key] = min(d, first.get(key, d))
    out = []
    for d, w in rows:
        gone = set()
        for i in range(len(w) - target + 1):
            if d is not None and first[tuple(w[i : i + target])] < d:
                gone |= set(range(i, i + target))
        kept = " ".join(x for i, x in enumerate(w) if i not in gone)
        out.append((d, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return out


def near(rows, k=3, percent=85):
    sets = []
    for d, t in rows:
        w = space_words(lower(t or ""))
        sets.append({tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set())
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= percent * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    comp = {}
    for i, (d, _) in enumerate(rows):
        comp[find(i)] = min(d, comp.get(find(i), d))
    return [
        (d, len(sets[i]), comp[find(i)], d == comp[find(i)]) for i, (d, _) in enumerate(rows)
    ]


def secrets(rows):
    kinds = (
        ("assign", r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8),
        ("access", r"AKIA[A-Z0-9]+", 0, 16),
        ("hex", r"[0-9a-f]+", 0, 32),
    )
    out = []
    for d, t in rows:
        spans = []
        for rank, (kind, pattern, group, least) in enumerate(kinds):
            flags = re.ASCII
            for m in re.finditer(pattern, t or "", flags):
                if len(m[group]) >= least:
                    spans.append((m.start(), rank, m.end(), kind))
        said = ",".join(f"{k}:{a}:{b}" for a, _, b, k in sorted(spans))
        n = [sum(s[1] == i for s in spans) for i in range(3)]
        out.append((d, *n, hashlib.sha256(said.encode()).hexdigest(), said))
    return out


def ascii_words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(text or ""))


def decontaminate(rows, items, window=10):
    spans = {}
    for item, t in items:
        w = ascii_words(t)
        n = min(window, len(w))
        for i in range(len(w) - n + 1 if n else 0):
            spans.setdefault(tuple(w[i : i + n]), set()).add(item)
    sizes = {len(x) for x in spans}
    out = []
    for d, t in rows:
        w = ascii_words(t)
        hit, found = set(), set()
        for n in sizes:
            for i in range(len(w) - n + 1):
                if (x := spans.get(tuple(w[i : i + n]))) is not None:
                    hit |= set(range(i, i + n))
                    found |= x
        said = ",".join(sorted(map(str, found)))
        out.append(
            (d, len(w), len(hit), len(found), hashlib.sha256(said.encode()).hexdigest(), bool(hit))
        )
    return out
