"""Plain Python versions of fingerprints, links and components."""

import re

import xxhash


def fingerprint(text, width=3):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    last = max(len(words) - width, 0)
    hashes = [xxhash.xxh64_intdigest(" ".join(words[i : i + width]).encode(), 42) for i in range(last + 1)]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def component_ids(rows, radius=2):
    """rows: (doc_id, fp); returns the component id of each."""
    fps = sorted({fp for _, fp in rows})
    root = {fp: fp for fp in fps}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(fps):
        for b in fps[i + 1 :]:
            if (a ^ b).bit_count() <= radius:
                root[find(a)] = find(b)
    least = {}
    for doc_id, fp in rows:
        if doc_id is not None:
            key = find(fp)
            least[key] = min(doc_id, least.get(key, doc_id))
    return [least.get(find(fp)) for _, fp in rows]
