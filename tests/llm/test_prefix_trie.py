import hashlib
import random
import re
import zlib

import duckdb
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from metricmart.llm import prefix_trie as P

CONVERSATIONS = T.StructType([
    T.StructField("conv_id", T.LongType()), T.StructField("turn", T.LongType()),
    T.StructField("role", T.StringType()), T.StructField("text", T.StringType()),
])


def turn_key(role, text):
    return hashlib.sha256(f"{len(role)}:{role}{text}".encode()).digest()


def rebuilt(rows):
    own = {}
    for c, turn, role, text in rows:
        if c is not None:
            own.setdefault(c, []).append((turn is not None, turn or 0, role or "", turn_key(role or "", text or ""), text or ""))
    own = {c: [(r, x) for _, _, r, _, x in sorted(turns)] for c, turns in own.items()}
    out = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        out[c] = own.get(c - c % 20, [])[:h] + turns[h:]
    return out


def brute(rows):
    members = {}
    convs = rebuilt(rows)
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            members.setdefault(tuple(turns[:d]), []).append(c)
    out = []
    for path, of in members.items():
        below = [p for p in members if p[:len(path)] == path]
        kids = [p for p in below if len(p) == len(path) + 1]
        leaves = [p for p in below if not any(q[:len(p)] == p and len(q) > len(p) for q in below)]
        saved = sum((len(members[p]) - 1) * len(re.findall(r"[^\x20\x09-\x0D]+", p[-1][1])) for p in below if p)
        ends = ",".join(str(c) for c in sorted(of) if len(convs[c]) == len(path))
        out.append((min(of), len(path), min(members[path[:-1]]) if path else None, len(of), len(kids), len(leaves),
                    saved, hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


NAMES = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def sample(seed, n=60):
    rnd = random.Random(seed)
    texts = ["hi", "hi there", "", None, "a  b\tc", "déjà vu", "x" * 3000]
    rows = []
    for c in rnd.sample(range(200), n):
        shared = rnd.random() < 0.5
        for turn in range(rnd.choice([1, 2, 3, 5, 8, 9, 16, 17, 40])):
            text = texts[turn % 3] if shared and turn < 30 else rnd.choice(texts)
            rows.append((c, turn if rnd.random() < 0.9 else None, rnd.choice(["user", None]) if not shared else "user", text))
    rows += rows[:5] + [(None, 0, "user", "lost")]
    rnd.shuffle(rows)
    return rows


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_against_brute_force_and_sql(spark, sf, seed):
    rows = sample(seed)
    frame = spark.createDataFrame(rows, CONVERSATIONS).withColumns({"node": F.lit(1), "block": F.lit("x"), "t1": F.lit(2)})
    folder = sf(conversations=frame)
    got = sorted((tuple(r[n] for n in NAMES) for r in P.op11_prefix_trie(spark, folder).collect()), key=str)
    want = brute(rows)
    assert got == want
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{folder}/conversations.parquet/*.parquet'")
    found = con.execute(P.OP11_SQL)
    names = [d[0] for d in found.description]
    assert sorted((tuple(r[names.index(n)] for n in NAMES) for r in found.fetchall()), key=str) == want


def test_long_conversations_and_hot_first_turn(spark):
    rows = [(c, t, "user", "go" if t < 300 else f"{c % 2}") for c in range(4) for t in range(301)]
    rows += [(c, 0, "user", "go") for c in range(10, 5000)]
    out = P.prefix_trie(P.numbered_turns(spark.createDataFrame(rows, CONVERSATIONS)))
    assert out.count() == 1 + 300 + 2
    root, top = (out.filter(f"depth = {d}").first() for d in (0, 1))
    assert (root.n_convs, root.n_children, root.n_leaves, root.conv_id, root.parent_conv_id) == (4994, 1, 2, 0, None)
    assert root.saved_tokens == 4993 + 299 * 3 + 2 * 1 == top.saved_tokens
    ends = ",".join(map(str, range(10, 5000)))
    assert top.ends_sha256 == hashlib.sha256(ends.encode()).hexdigest()
    assert out.filter("depth = 300").first().n_children == 2


def test_empty_table(spark, sf):
    assert P.op11_prefix_trie(spark, sf(conversations=spark.createDataFrame([], CONVERSATIONS))).count() == 0


def test_turnless_conversations_are_members_of_the_root(spark):
    turns = P.with_family_heads(P.numbered_turns(spark.createDataFrame([(21, 0, "user", "x")], CONVERSATIONS)), 20, 3)
    taken = zlib.crc32(b"21") % 4
    rows = P.prefix_trie(turns).collect()
    assert len(rows) == (1 if taken else 2) and rows[0].n_convs == 1
