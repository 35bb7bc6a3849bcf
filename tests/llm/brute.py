"""Plain versions of the operators, for small tables. They share no code with the operators."""

import base64
import hashlib
import re
import zlib
from collections import defaultdict

import xxhash


def fingerprints(rows):
    out = []
    for _, text in rows:
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        words = re.findall(r"[^\x20\x09-\x0D]+", low)
        grams = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
        h = [xxhash.xxh64(g.encode(), seed=42).intdigest() for g in grams]
        out.append(sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)))
    return out


def components(ids, prints, radius=3):
    root = list(range(len(ids)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(ids)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= radius:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    low = defaultdict(list)
    for i, d in enumerate(ids):
        low[find(i)].append(d)
    return [min((x for x in low[find(i)] if x is not None), default=None) for i in range(len(ids))]


def decontaminate(docs, items):
    def words(t):
        return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))

    windows = defaultdict(set)
    for i, t in items:
        w = words(t)
        if w:
            for k in range(max(1, len(w) - 12)):
                windows[tuple(w[k : k + 13])].add(str(i) if i is not None else "")
    sizes = {len(w) for w in windows}
    out = []
    for d, t in docs:
        w, hit, own = words(t), set(), set()
        for n in sizes:
            for k in range(len(w) - n + 1):
                if (g := tuple(w[k : k + n])) in windows:
                    hit |= set(range(k, k + n))
                    own |= windows[g]
        out.append((d, len(w), len(hit), len(own), hashlib.sha256(",".join(sorted(own)).encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(w)))
    return out


def luhn(d):
    return sum(sum(divmod(2 * int(c), 10)) if i % 2 else int(c) for i, c in enumerate(d[::-1])) % 10 == 0


def base_pii(text):
    text, out = text or "", []
    for k, (name, pattern, good) in enumerate([
        ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda s: True),
        ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda s: all(int(p) <= 255 for p in s.split("."))),
        ("card", r"[0-9]([\x20-]?[0-9])+", lambda s: 12 <= len(d := re.sub("[^0-9]", "", s)) <= 19 and luhn(d)),
        ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda s: 9 <= len(re.sub("[^0-9]", "", s)) <= 15),
    ]):
        out += [(m.start(), k, m.end(), name) for m in re.finditer(pattern, text) if good(m[0])]
    return [(n, s, e) for s, _, e, n in sorted(out)]


def warc(pages):
    first = {}
    for p, h in pages:
        if p is not None:
            first[h or ""] = min(first.get(h or "", p), p)
    out = []
    for p, h in pages:
        raw = (h or "").encode()
        f = first.get(h or "")
        again = f is not None and p != f
        out.append((p, len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode(), "revisit" if again else "response", f if again else None))
    return out


def chat(rows):
    by = defaultdict(list)
    for c, turn, role, text in rows:
        by[c].append((turn is None, turn or 0, role or "", text or ""))
    out = {}
    for c, turns in by.items():
        turns.sort()
        said = "".join(f"{r}\n{t}\n" for *_, r, t in turns)
        learnt = "".join(t for *_, r, t in turns if r == "assistant")
        out[c] = (len(turns), hashlib.sha256(said.encode()).hexdigest(), len(learnt), hashlib.sha256(learnt.encode()).hexdigest())
    return out


def payload(text):
    raw = (text or "").encode()
    padded = raw + b"\xff" * (-len(raw) % 576 or (0 if raw else 576))
    return len(raw), len(padded), hashlib.sha256(padded).hexdigest(), zlib.crc32(padded[-32:])


def repeated_passages(table, least):
    """(doc_id, begin, end, n_words, kept_in) by comparing every passage of ``least`` words with all before it."""
    seen, out = {}, []
    for d, text in sorted(set(table), key=lambda r: (r[0] is None, r[0] or 0, r[1] or "")):
        raw = (text or "").encode()
        words = [m.span() for m in re.finditer(rb"[^\x20\x09-\x0D]+", raw)]
        spans = []
        for i in range(len(words) - least + 1):
            begin, end = words[i][0], words[i + least - 1][1]
            first = seen.setdefault(raw[begin:end], (d, i))
            if first[0] == d and i < first[1] + least:
                continue
            if spans and begin <= spans[-1][1]:
                spans[-1][1:3] = [end, i + least]
            else:
                spans.append([begin, end, i + least, i, first[0]])
        out += [(d, b, e, w1 - w0, k) for b, e, w1, w0, k in spans]
    return out
