"""Coverage samples against a scan of the whole table, and fingerprints hashed side by side."""

import random

from spanlake import rules
from spanlake.functions import text
from spanlake.sources import corpus


def brute(rows, limit, negative, misc):
    langs, sizes = ["en", "de"], ["short", "medium", "long"]
    supported = [t for t in rules.ENTITY_TYPES if t not in ("MISC", "SECRET", "HOSTNAME", "FILE_PATH", "IDENTIFIER")]
    goal = {"negative": min(negative, limit)}
    goal["misc"] = min(misc, limit - goal["negative"])
    goal["supported"] = max(0, limit - sum(goal.values()))
    pairs = [f"{a}:{b}" for a in langs for b in sizes]
    quotas = {k: corpus.quota(goal[k], pairs) for k in ("negative", "misc")} | {"supported": corpus.quota(goal["supported"], [f"{a}:{t}:{b}" for a in langs for t in supported for b in sizes])}
    used, total, taken, spare = {}, dict.fromkeys(goal, 0), [], []
    for i, lang, size, types in sorted(rows):
        kind = "negative" if not types else "misc" if "MISC" in types else "supported"
        names = [f"{lang}:{size}"] if kind != "supported" else [f"{lang}:{t}:{size}" for t in sorted(set(types)) if t in supported]
        free = sorted((used.get((kind, x), 0), quotas[kind].get(x, 0), x) for x in names if used.get((kind, x), 0) < quotas[kind].get(x, 0))
        if free and total[kind] < goal[kind]:
            used[kind, free[0][2]] = free[0][0] + 1
            total[kind] += 1
            taken.append(i)
        else:
            spare.append(i)
    return sorted(taken + spare[: max(0, limit - len(taken))])


def test_coverage_sample_equals_a_scan_of_all_rows(spark):
    r = random.Random(5)
    types = ["EMAIL", "PHONE", "PERSON", "IBAN", "MISC", "SECRET"]
    for limit, negative, misc, n in ((40, 8, 6, 900), (15, 20, 3, 200), (300, 10, 10, 120)):
        rows = [(i, r.choice(["en"] * 5 + ["de", "fr"]), r.choice(["short", "short", "medium", "long"]), r.sample(types, r.choice([0, 1, 1, 1, 2, 3]))) for i in range(n)]
        rows.sort(key=lambda x: x[3] != ["EMAIL"])  # one bucket comes first and is far too large
        rows = [(i, *x[1:]) for i, x in enumerate(rows)]
        df = spark.createDataFrame(rows, "id int, language string, length_bucket string, types array<string>").repartition(5)
        assert sorted(x["id"] for x in corpus.coverage_sample(df, limit, negative, misc).collect()) == brute(rows, limit, negative, misc)


def serial(t):
    t = t.replace("\r\n", "\n").strip()
    one, two, mask = 0xDEADBEEF, 0x41C6CE57, 0xFFFFFFFF
    units = memoryview(t.encode("utf-16-le", "surrogatepass")).cast("H")
    for u in units:
        one, two = (one ^ u) * 2654435761 & mask, (two ^ u) * 1597334677 & mask
    return text._finished(len(units), one, two)


def test_fingerprints_side_by_side(spark):
    r = random.Random(1)
    texts = ["".join(chr(r.choice([r.randrange(32, 127), r.randrange(0x400, 0x500), r.randrange(0x1F600, 0x1F650)])) for _ in range(r.choice([0, 1, 5, 50, 700]))) for _ in range(120)] + ["", " \r\n", "a\r\nb", "x" * 5000]
    assert text.text_fingerprints(texts) == [serial(t) for t in texts] and text.text_fingerprints([]) == []
    df = spark.createDataFrame([(i, t) for i, t in enumerate([*texts, None])], "i int, t string").repartition(3)
    assert {x["i"]: x["f"] for x in df.select("i", text.fingerprint("t").alias("f")).collect()} == {i: serial(t) for i, t in enumerate(texts)} | {len(texts): None}
