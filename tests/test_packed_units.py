import random
import re

from pyspark.sql import functions as F

from tessera.functions.passages import bullet_units, packed_units, stripped_lines


def by_hand(block):
    """The rule, step by step: units at bullets, at most two units or 900 characters, the heading repeated."""
    lines = [x.strip() for x in block.splitlines() if x.strip()]
    if len(block) < 1100 or not lines:
        return [block]
    heading = lines[0] if re.match(r"^\d+(?:\.\d+)*\.?\s+.+$", lines[0]) else None
    units = []
    for line in lines[1:] if heading else lines:
        if units and not line.startswith(("–", "-", "•")):
            units[-1] += "\n" + line
        else:
            units.append(line)
    if len(units) < 3:
        return [block]
    pieces, size = [], 0
    for unit in units:
        if pieces and len(pieces[-1]) < 2 and size + len(unit) <= 900:
            pieces[-1].append(unit)
            size += len(unit)
        else:
            pieces.append([unit])
            size = len(heading or "") + len(unit)
    return ["\n".join(([heading] if heading else []) + p) for p in pieces]


def test_packing_and_units_against_the_rule(spark):
    rng = random.Random(3)
    blocks = ["", " \n" * 700, "short\n- a\n- b\n- c", "x" * 1100, "1.2. Heading only " + "y" * 1200, "1. H\n- a\n- b\n" + "z" * 1100]
    for _ in range(150):
        head = rng.choice(["", "2.1 Điều trị\n", "3. Theo dõi\r\n", "Không số\n"])
        body = [rng.choice(["- ", "– ", "• ", "", "  - ", " • "]) + "từ " * rng.choice([1, 5, 40, 150, 320]) for _ in range(rng.randrange(1, 9))]
        blocks.append(head + rng.choice(["\n", "\r\n", "\n\n"]).join(body))
    df = spark.createDataFrame(list(enumerate(blocks)), "id int, b string").select("id", packed_units(F.col("b")).alias("p"), bullet_units(stripped_lines(F.col("b"))).alias("u"))
    out = {r.id: r for r in df.collect()}
    assert [list(out[i].p) for i in range(len(blocks))] == [by_hand(b) for b in blocks]
    assert sum(len(r.p) > 1 for r in out.values()) > 20
    assert list(out[2].u) == ["short", "- a", "- b", "- c"] and list(out[0].u) == []
