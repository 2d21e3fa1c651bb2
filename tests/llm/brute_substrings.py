"""Substring dedup over all spans in plain Python, without the operator's code: texts are read character by character."""

import xxhash

WINDOW, MIN_SENTENCES, MIN_WORDS, SHORT, MIN_RUN = 16, 2, 15, 8, 35


def ends_of_sentences(t):
    """Places after the white space that follows marks of an end, or a line end."""
    out, i, n = [], 0, len(t)
    while i < n:
        if t[i] in ".!?":
            j = i
            while j < n and t[j] in ".!?":
                j += 1
            while j < n and t[j] in "\"'”’»)]":
                j += 1
            if j < n and t[j].isspace():
                while j < n and t[j].isspace():
                    j += 1
                out.append(j)
                i = j
                continue
        elif t[i] == "\n":
            while i < n and t[i].isspace():
                i += 1
            out.append(i)
            continue
        i += 1
    return out


def pieces(t):
    out, at = [], 0
    for end in [*ends_of_sentences(t), len(t)]:
        if end > at:
            out += cut_long(t[at:end])
            at = end
    return out


def cut_long(s):
    words = s.split()
    if len(words) <= WINDOW:
        return [s]
    h = [xxhash.xxh32_intdigest(w.lower()) for w in words[:-1]]
    cuts = set()
    for i in range(len(h) - WINDOW + 1):
        least = min(h[i : i + WINDOW])
        cuts.add(max(j for j in range(i, i + WINDOW) if h[j] == least) + 1)
    out, at, seen, inside = [], 0, 0, False
    for k, c in enumerate(s):
        if not c.isspace() and not inside:
            if seen in cuts:
                out.append(s[at:k])
                at = k
            seen, inside = seen + 1, True
        elif c.isspace():
            inside = False
    return [*out, s[at:]]


def runs(cut):
    """(first, after the last, words) of every span."""
    words = [s.lower().split() for s in cut]
    total = sum(map(len, words))
    if total < SHORT:
        return
    if len(cut) < MIN_SENTENCES or total < MIN_WORDS:
        yield 0, len(cut), tuple(x for w in words for x in w)
        return
    for a in range(len(cut)):
        for b in range(a + MIN_SENTENCES, len(cut) + 1):
            got = tuple(x for w in words[a:b] for x in w)
            if len(got) >= MIN_WORDS:
                yield a, b, got
                break


def brute_dedup(rows):
    """{id: text} of rows (id, text) with ids of their own."""
    first, out = {}, {}
    for i, t in sorted(rows):
        cut, lost = pieces(t or ""), set()
        for a, b, got in runs(cut):
            if first.setdefault(got, (i, a)) != (i, a):
                lost |= set(range(a, b))
        for k in sorted(lost):
            if k not in lost or k - 1 in lost:
                continue
            end = k
            while end in lost:
                end += 1
            if end - k < len(cut) and sum(len(cut[x].split()) for x in range(k, end)) < MIN_RUN:
                lost -= set(range(k, end))
        out[i] = "".join(s for k, s in enumerate(cut) if k not in lost) if t else t
    return out
