"""Near-duplicate classes by comparing all pairs of texts, word by word: nothing of it is shared with the operator."""


def common_words(a, b):
    """Length of the longest common subsequence."""
    row = [0] * (len(b) + 1)
    for x in a:
        before = 0
        for j, y in enumerate(b):
            here = row[j + 1]
            row[j + 1] = before + 1 if x == y else max(here, row[j])
            before = here
    return row[-1]


def near_classes(rows):
    """doc_id -> least doc_id of its class, of rows (doc_id, text)."""
    tokens = {i: tuple((t or "").encode().split()) for i, t in rows}
    grams = {i: {w[k : k + min(5, len(w))] for k in range(max(1, len(w) - 4))} for i, w in tokens.items()}
    root = {i: i for i in tokens}

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(tokens)
    for x, a in enumerate(ids):
        for b in ids[x + 1 :]:
            if not tokens[a] or not tokens[b] or top(a) == top(b):
                continue
            if tokens[a] != tokens[b]:
                both = len(grams[a] & grams[b])
                if both < 0.8 * (len(grams[a]) + len(grams[b]) - both) or common_words(tokens[a], tokens[b]) < 0.8 * max(len(tokens[a]), len(tokens[b])):
                    continue
            r, s = sorted((top(a), top(b)))
            root[s] = r
    return {i: top(i) for i in ids}
