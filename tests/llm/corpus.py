"""Awkward documents, and plain definitions to hold operators against."""

import random
import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words(text):
    return WORD.findall(text or "")


def awkward(seed=7):
    """(doc_id, text): near and exact copies, shared passages, repeats within a text, long, short, empty and null ones, ties."""
    rng = random.Random(seed)
    vocabulary = [a + b for a in ("ba", "ke", "Lo", "mü", "ñi", "x") for b in ("r", "st", "nd,", "ß", "l.", "")]
    text = lambda n: [rng.choice(vocabulary) + str(rng.randrange(30)) for _ in range(n)]
    base, passage, other = text(150), text(60), text(300)
    rows = []
    for i in range(40):  # copies, each with a few words changed
        own = list(base)
        for _ in range(i % 9):
            own[rng.randrange(len(own))] = f"new{rng.randrange(10**6)}"
        rows.append(" ".join(own))
    rows += [" ".join(text(rng.randrange(80)) + passage + text(rng.randrange(80))) for _ in range(25)]
    rows += [" ".join(passage + [str(i)]) for i in range(6)]
    rows += [" ".join(other)] * 5 + [" ".join(other).upper(), "\n".join(other), "\t" + "  ".join(other[:250]) + "\x0b"]
    rows += [" ".join(passage * 3), " ".join(["same"] * 100), " ".join(text(20_000))]
    rows += ["", "   \n\t", None, None, "one", "One", "one two three four", "one two three four", "a b c d e", "A B C D e", "a b c d e f", " nbsp stays one", "🙂 漢字 é"]
    ids = rng.sample(range(1000), len(rows))
    return list(zip(ids, rows))


def components(nodes, links):
    parent = {n: n for n in nodes}

    def find(n):
        while parent[n] != n:
            parent[n] = parent[parent[n]]
            n = parent[n]
        return n

    for a, b in links:
        x, y = find(a), find(b)
        parent[max(x, y)] = min(x, y)
    return {n: find(n) for n in nodes}
