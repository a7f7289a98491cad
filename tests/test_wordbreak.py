"""Word-break of run-together addresses: own cases, pure re-spacing, and all cuts by brute force."""

import itertools
import random
import re

import pytest

from ledgerloom.operators import wordbreak as W
from ledgerloom.operators.segments import Keywords, Tier

KW = Keywords(
    tiers={
        "premises_unit": Tier(1, head=("flat", "plot", "shop", "office", "gala"), tail=("floor",)),
        "structural": Tier(1, head=("block", "wing", "tower", "phase"), tail=("tower",)),
        "building_name": Tier(2, head=("hotel",), tail=("building", "house", "mahal", "plaza", "wadi")),
        "estate_zone": Tier(2, tail=("park", "estate"), phrases=("udyog nagar", "midc area")),
        "thoroughfare": Tier(3, tail=("road", "street", "marg")),
        "locality": Tier(4, head=("sector", "pocket"), tail=("nagar", "halli", "wadi", "pur")),
    }
)
V = W.vocabulary(KW)

CASES = {
    "FLATNO302": "FLAT NO 302",
    "LAKESIDEPLAZA": "LAKESIDE PLAZA",
    "2NDFLOORWINGC": "2ND FLOOR WING C",
    "BLOCKB": "BLOCK B",
    "PLOTNO45": "PLOT NO 45",
    "SUNRISEBUILDING4": "SUNRISE BUILDING 4",
    "LAKESIDEROAD": "LAKESIDE ROAD",
    "SECTOR62": "SECTOR 62",
    "PHASEIISTATION": "PHASE II STATION",
    # stays whole: fused names, no anchor, one role twice, numbers, too short or too long
    "MAHALAXMI": "MAHALAXMI", "KORAMANGALA": "KORAMANGALA", "BOMMANAHALLI": "BOMMANAHALLI", "GREENFIELDBUSINESS": "GREENFIELDBUSINESS",
    "PARKSTREET": "PARKSTREET", "TOWERROAD": "TOWERROAD", "560102": "560102", "PLOT4": "PLOT4", "FLAT302" * 6: "FLAT302" * 6, "TOWERS": "TOWERS", "RAMWADI": "RAMWADI",
}


@pytest.mark.parametrize("run", CASES)
def test_cases(run):
    assert " ".join(W.break_run(run, V)) == CASES[run]


def all_covers(run):
    """Every way to cut a run, scored piece by piece with both neighbours in view: (points, -pieces, ends)."""
    best = None
    for n in range(len(run)):
        for cuts in itertools.combinations(range(1, len(run)), n):
            ends = (*cuts, len(run))
            cores = [W.core(run[a:b]) for a, b in zip((0, *cuts), ends)]
            if not all(cores) or any(b - a > W.MOST_PIECE for a, b in zip((0, *cuts), ends)):
                continue
            points = -50 * n
            for i, c in enumerate(cores):
                before, after = (V.look(cores[i - 1]) if i else None), (V.look(cores[i + 1]) if i + 1 < len(cores) else None)
                x = V.look(c)
                if x is None or (i + 1 < len(cores) and after is None) or (i and before is None) or (i and not V.apart(cores[i - 1], c)):
                    break
                if x.letter and not (i and before.structure):
                    break
                unit_after = after is not None and after.letter and x.structure
                points += x.points + 200 * x.letter
                points += 200 * (x.role == "head" and x.strong and (not i or before.strong))
                points += 200 * (x.role == "tail" and x.strong and (after is None or after.strong or unit_after or after.role == "head" or after.digits))
            else:
                best = max(best, (points, -n, ends)) if best else (points, -n, ends)
    return best


def test_all_cuts_of_short_runs():
    rnd = random.Random(4)
    words = ["FLAT", "12", "7", "B", "II", "ROAD", "PARK", "BLOCK", "NAGAR", "SAI", "LAKE", "TOWER", "X", "5A", "NO", "MIDC", "HALLI"]
    split = 0
    for _ in range(250):
        run = "".join(rnd.choice(words) for _ in range(rnd.randrange(2, 5)))[: rnd.randrange(6, 13)]
        if len(run) < W.LEAST_RUN:
            continue
        got, best = W.break_run(run, V), all_covers(run)
        uncut = V.look(W.core(run))
        floor = -300 if uncut is None or uncut.letter else uncut.points + 200 * bool(uncut.strong and uncut.role)
        want = [run]
        if best is not None and best[1] and best[0] >= floor + 75:
            pieces = [run[a:b] for a, b in zip((0, *best[2][:-1]), best[2])]
            want = pieces if W.anchored([W.core(p) for p in pieces], V) else [run]
        assert got == want, (run, best)
        split += len(got) > 1
    assert split > 40


def test_only_spaces_are_added(spark):
    rnd = random.Random(9)
    letters = "FLATBLOCKROADPARK0123456789-/.,#é nagarTower "
    texts = ["".join(rnd.choice(letters) for _ in range(rnd.randrange(60))) for _ in range(150)] + [" ".join(CASES), "", " a  b ", None]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = df.select("t", W.respaced(df.t, KW).alias("r"), W.respaced(df.t, Keywords({})).alias("same")).collect()
    assert len(got) == len(texts)
    for t, r, same in got:
        assert same == t and ((t is None and r is None) or re.sub(r"\s", "", r) == re.sub(r"\s", "", t))
        assert t is None or W.respace(r, lambda run: [run]) == r
    assert {r["t"]: r["r"] for r in got}[" ".join(CASES)] == " ".join(CASES.values())
