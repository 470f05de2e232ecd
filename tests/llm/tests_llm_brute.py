"""Plain forms of what the stages decide, for small tables."""

import re

WORD = r"[^\x20\x09-\x0D]+"


def link_groups(rows):
    """Least id of the group of each row, linked at 0.8 of five-word shingles; rows without words are groups of their own."""
    sets = {}
    for i, text in rows:
        w = re.findall(WORD, re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        sets[i] = frozenset(tuple(w[k : k + 5]) for k in range(len(w) - 4)) if len(w) > 4 else frozenset([tuple(w)] if w else [])
    group = {i: i for i in sets}
    for i in sets:
        for j in sets:
            both = len(sets[i] & sets[j])
            if i < j and sets[i] and sets[j] and 100 * both >= 80 * (len(sets[i]) + len(sets[j]) - both):
                low, high = sorted((group[i], group[j]))
                group = {k: low if g == high else g for k, g in group.items()}
    return group


def hit_words(text, item, width=13):
    def words(t):
        return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))

    w, b = words(text), words(item)
    hit = set()
    for i in range(len(w) - width + 1):
        for j in range(len(b) - width + 1):
            if w[i : i + width] == b[j : j + width]:
                hit |= set(range(i, i + width))
    return len(hit)


def base_spans(text):
    return re.findall(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+|[0-9]+(?:\.[0-9]+){3}", text or "")
