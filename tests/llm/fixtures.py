"""Small manifests with planted near copies and odd values, and plain versions of the match."""

import random

SCHEMA = (
    "row_id bigint, batch_no int, path string, label int, source string, generator string, split string, sha256 string, width int, height int, phash string, added_at timestamp,"
    " sha string, ph bigint, t string, e string, key bigint, rows string, node string, component string, _split string, _sha string, value string"
)
EXTRA = ("x", 1, "x", "x", 2, "x", "x", "x", "x", "x", "x")
SPLITS = ["train", "train", " TRAIN", "val", "test-unseen", "eval_only", "held", "dev", None]


def manifest(n: int, seed: int = 1, centres: int = 12, hot: bool = False) -> list[tuple]:
    """Rows around a few hash centres, so that chains of near copies arise; some hashes are missing or damaged."""
    rng = random.Random(seed)
    points = [rng.getrandbits(64) for _ in range(centres)]
    shas = [f"{rng.getrandbits(256):064x}" for _ in range(n // 3 + 1)]
    out = []
    for i in range(n):
        p = rng.choice(points) if rng.random() < 0.5 else rng.getrandbits(64)
        if hot and rng.random() < 0.4:
            p = 0
        for _ in range(rng.choice([0, 0, 1, 2, 3, 4, 5])):
            p ^= 1 << rng.randrange(64)
        ph = f"{p:016x}"
        ph = rng.choice([ph, ph, ph, ph, "0x" + ph.upper(), f" {ph}\t", None, "", ph[:15]])
        s = rng.choice(shas) if not (hot and rng.random() < 0.3) else shas[0]
        s = rng.choice([s, s, s, "SHA256:" + s.upper(), None, s[:60]])
        source, generator = rng.choice(["Alpha_1", "alpha 1", "beta", "gamma", None, "--"]), rng.choice(["real", "Real", "gen.x", "gen-y", None])
        out.append((i + 1, rng.choice([0, 0, 0, 1, 2, 3]), None, rng.choice([0, 1, 1, None, 7]), source, generator, rng.choice(SPLITS), s, rng.choice([None, 0, 5, 900]), 7, ph, None, *EXTRA))
    return out


def digits(v, n):
    import re

    m = re.fullmatch(r"(?:[a-z][a-z0-9_-]*:\s*)?(?:0x)?([0-9a-f]{%d})" % n, v.strip().lower()) if v else None
    return m.group(1) if m else None


def hashes(row):
    ph = digits(row[10], 16)
    return digits(row[7], 64), None if ph is None else int(ph, 16)


def match(a, b) -> bool:
    return a[0] is not None and a[0] == b[0] or a[1] is not None and b[1] is not None and (a[1] ^ b[1]).bit_count() <= 4


def split(row):
    s = row[6].strip().lower().replace("-", "_") if row[6] else None
    return s if s in ("train", "val", "test_unseen", "held", "eval_only") else None


def name(v):
    s = "".join(c for c in v.lower() if c.isalnum()) if v else ""
    return s or None
