"""Small documents with copies, near copies, shared passages, and every edge that a column may have."""

import random
import re

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, blk string, bucket int, payload string, rep string"
LOWER = {chr(65 + i): chr(97 + i) for i in range(26)}


def alnum(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(str.maketrans(LOWER)))


def spaced(text):
    return (text or "").encode().split()


def prose(rng, n):
    syllables = ["the", "an", "or", "re", "ti", "ñb", "él", "on", "sh", "日本", "ing", "st"]
    return " ".join("".join(rng.choice(syllables) for _ in range(rng.randint(1, 4))) for _ in range(n))


def documents(seed=0, n=60):
    rng = random.Random(seed)
    base = [prose(rng, rng.randint(1, 220)) for _ in range(n)]
    passage = prose(rng, 40)
    texts = []
    for i, t in enumerate(base):
        words = t.split(" ")
        kind = i % 6
        if kind == 1:
            texts.append(base[i - 1])
        elif kind == 2:
            words = base[i - 2].split(" ")
            for _ in range(max(1, len(words) // 60)):
                words[rng.randrange(len(words))] = "edited"
            texts.append(" ".join(words))
        elif kind == 3:
            texts.append(t + "\n" + passage + "\t" + prose(rng, 5))
        else:
            texts.append(t)
    texts += [None, "", " \t\n", "a", "aa " * 300, "x" * 400, "x" * 400, "ab" * 90 + " " + "ab" * 90, passage, "Ärger über Öl " * 9, "a b c d", "a b c d"]
    rows = [(1000 - 7 * i, t, "en" if i % 2 else None, f"src{i % 3}" if i % 5 else None, None if t is None else len(t), "clash", 1, "p", "r") for i, t in enumerate(texts)]
    rows.append(rows[3])  # a repeated row
    return rows


def frame(spark, rows=None, parts=5):
    return spark.createDataFrame(documents() if rows is None else rows, SCHEMA).repartition(parts)
