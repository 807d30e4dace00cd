"""Small documents with the difficult cases, and plain versions of what the operators compute."""

import random

import numpy as np
import pyarrow as pa

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, kept string, node long, d string"
SPACE = b" \t\n\x0b\x0c\r"


def prose(r: random.Random, n: int, words: list[str] | None = None) -> str:
    words = words or ["".join(r.choice("abcdefghijk") for _ in range(r.randint(2, 7))) for _ in range(200)]
    return " ".join(r.choice(words) for _ in range(n))


def documents(seed: int = 1) -> list[tuple]:
    """Exact and near copies, shared passages, periodic and very long texts, empty, blank and null texts, null ids, repeated rows."""
    r = random.Random(seed)
    texts: list[str | None] = [prose(r, r.randint(5, 120)) for _ in range(25)]
    base = prose(r, 100)
    for i in range(6):
        w = base.split()
        for _ in range(i // 2):
            w[r.randrange(len(w))] = f"x{r.random():.3f}"
        texts.append(" ".join(w))
    passage = prose(r, 60)
    texts += [f"{prose(r, 20)} {passage} {prose(r, 30)}" for _ in range(4)]
    texts += [passage * 2, "ab" * 300, "a", "", " \n\t ", None, "Four words are HERE", "four WORDS are here", "ünï çødé " * 40, "ein\x85zwei\xa0drei\x1cvier " * 5, prose(r, 4000), "<|endoftext|> x", "one two three four five"]
    rows = [(i, t, r.choice(["en", "de", None]), r.choice(["a", "a", "b", None]), len(t or ""), "x", 1, "y") for i, t in enumerate(texts)]
    rows += [rows[0], rows[0], (None, texts[3], "en", None, 1, None, None, None), (None, None, None, None, None, None, None, None), (7_000_000_000, "late é text", "de", "ä", 5, "", 0, "")]
    r.shuffle(rows)
    return rows


def frame(spark, rows: list[tuple], schema: str = SCHEMA, parts: int = 3):
    return spark.createDataFrame(rows, schema).repartition(parts)


def lower(b: bytes) -> bytes:
    return b.translate(bytes(c + 32 if 65 <= c <= 90 else c for c in range(256)))


def shingles(text: str | None, n: int = 5) -> set:
    w = lower((text or "").encode()).split()
    if not w:
        return set()
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)}


def groups(sets: list[set]) -> list[int]:
    """For each set the first row of its group, by comparing all pairs."""
    up = list(range(len(sets)))

    def root(i: int) -> int:
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(sets)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 75 * len(sets[i] | sets[j]):
                a, b = sorted((root(i), root(j)))
                up[b] = a
    return [root(i) for i in range(len(sets))]


def arrow(texts: list) -> pa.Array:
    return pa.array(texts, pa.string())


def bytes_and_offsets(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    b = [t.encode() for t in texts]
    return np.frombuffer(b"".join(b), np.uint8), np.concatenate([[0], np.cumsum([len(x) for x in b])]).astype(np.int64)
