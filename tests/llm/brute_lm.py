"""The same bigram model over plain dictionaries."""

import math
import re
import zlib
from collections import Counter

END = "\0end"


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def scores(rows, mass):
    """{doc_id: (held_out, n_tokens, n_known, N, base, score)}"""
    one, two = Counter(), Counter()
    texts = {d: [*words(t), END] for d, t in rows}
    out = {d: zlib.crc32(str(d).encode()) % 7 == 2 for d in texts}
    for d, ws in texts.items():
        if not out[d]:
            one.update(ws)
            two.update(zip([END, *ws], ws))
    n, v = sum(one.values()), len(one)
    p = lambda w: (one[w] + 1) / (n + v + 1)
    return {
        d: (
            out[d],
            len(ws),
            sum(one[w] > 0 for w in ws),
            n,
            sum(math.log10(p(w)) for w in ws),
            sum(math.log10((two[a, b] + mass * p(b)) / (one[a] + mass)) for a, b in zip([END, *ws], ws)),
        )
        for d, ws in texts.items()
    }
