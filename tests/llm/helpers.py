"""Plain versions of what the operators compute, and tables of hard cases."""

import hashlib
import re
import zlib
from collections import defaultdict

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
DOCS = "doc_id long, text string, lang string, source string, n_chars long, id long, part int"


def hard_cases():
    """Nulls, empty and long texts, copies, near copies, repeated rows, and columns that clash with inner names."""
    base = " ".join(f"w{i}" for i in range(60))
    near = base.replace("w30", "v30")
    far = " ".join(f"u{i}" for i in range(60))
    texts = [None, "", " \t\n ", "one", "one two three", "ONE two three", base, base, base.upper(), near, near + " x", far, "long " * 30000, "äöü ß Ñ é", "a\x00b", "12 34 !!", "日本語 テキスト", thue_morse(2048), thue_morse(2048, "ba"), "blank " + " " * 70000 + "x"]
    rows = [(i, t, "en" if i % 3 else None, ("a", "b", None)[i % 3], None, i, i) for i, t in enumerate(texts)]
    again = [(3, "another text of id three", "en", "a", 1, 1, 1), (9, "a second text of id nine", None, "b", 1, 1, 1), (None, near, "en", None, 0, 0, 0)]
    return [*rows, rows[6], rows[6], *again, (None, "nothing has an id", "en", "a", 1, 1, 1), (None, base, None, None, None, None, None)]


def words(text):
    return WORD.findall(text or "")


def shingles(text, size=5):
    w = WORD.findall((text or "").translate(LOWER))
    return frozenset(tuple(w[i : i + size]) for i in range(len(w) - size + 1)) if len(w) >= size else frozenset([tuple(w)] if w else [])


def components(rows, percent=80):
    """[(id, size, smallest linked id)] of rows (id, text), by comparing all rows that share a shingle."""
    sets = [shingles(t) for _, t in rows]
    holders, root = defaultdict(set), list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, s in enumerate(sets):
        for g in s:
            holders[g].add(i)
    for i, s in enumerate(sets):
        for j in {j for g in s for j in holders[g] if j > i}:
            both = len(s & sets[j])
            if 100 * both >= percent * (len(s) + len(sets[j]) - both):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    least = {}
    for i, (name, _) in enumerate(rows):
        if name is not None:
            least[find(i)] = min(name, least.get(find(i), name))
    return [(name, len(sets[i]), least.get(find(i))) for i, (name, _) in enumerate(rows)]


def thue_morse(n, letters="ab"):
    """A word and its complement agree in every polynomial hash modulo a power of two, if they are long enough."""
    return "".join(letters[bin(i).count("1") % 2] for i in range(n))


def keep_latest(rows):
    """Of equal texts the row with the largest id; rows of (id, text)."""
    best = {}
    for i, t in rows:
        key = (t or "").translate(LOWER)
        if key not in best or (i is not None and (best[key] is None or i > best[key])):
            best[key] = i
    return best


def mix(rows, weights=(3, 1, 2), share=1.5, most=2):
    """{id: taken} and {source: target}; rows of (id, text, source), ids unique."""
    size = {i: len(words(t)) for i, t, _ in rows}
    total = defaultdict(int)
    for i, _, s in rows:
        total[s] += size[i]
    order = sorted(total, key=lambda s: (s is None, s or ""))
    weight = {s: float(weights[k % len(weights)]) for k, s in enumerate(order)}
    budget, open_, target = share * sum(total.values()), set(order), {}
    while open_:
        level = budget / sum(weight[s] for s in open_)
        over = {s for s in open_ if level * weight[s] >= most * total[s]}
        for s in over or open_:
            target[s] = float(most * total[s]) if over else level * weight[s]
        budget -= sum(target[s] for s in over)
        if not over:
            break
        open_ -= over
    taken = {}
    for s in order:
        own = sorted((int(hashlib.md5(f"0:{'null' if i is None else i}".encode()).hexdigest()[:15], 16), i) for i, _, t in rows if t == s)
        whole = int(target[s])
        epochs = whole // total[s] if total[s] else 0
        left = whole - epochs * total[s]
        for _, i in own:
            last = min(size[i], left)
            taken[i] = epochs * size[i] + last
            left -= last
    return taken, target


def pieces(ids_of, window=2048):
    """(id, start, length, crc, tokens, sequence, offset) of texts' ids in order."""
    import struct

    at, out = 0, []
    for i, ids in ids_of:
        start = 0
        while start < len(ids):
            n = min(len(ids) - start, window - at % window)
            part = ids[start : start + n]
            out.append((i, start, n, zlib.crc32(struct.pack(f"<{n}I", *part)), len(ids), at // window, at % window))
            start, at = start + n, at + n
    return out
