"""Tables' metadata, and the acceptance of tournaments on a small case."""

from pathlib import Path

import pandas as pd

from skirmish.plans import catalogue, evidence
from skirmish.plans.contest import Tables


def test_artifact_metadata(spark, sf):
    for r in catalogue.queries()["artifact_metadata"](spark, sf).collect():
        path = Path(sf) / f"{r.table}.parquet"
        files = [path] if path.is_file() else list(path.rglob("*.parquet"))
        assert (r.files, r.bytes, r.newest) == (len(files), sum(f.stat().st_size for f in files), max(int(f.stat().st_mtime) for f in files))
        assert r.rows == len(pd.read_parquet(path))


def test_accepted_tournaments(spark):
    """The newest sampled contest with a line-up decides; older ones, and a tournament without any, don't."""
    day = 86_400
    rows = [("A", 1, 10 * day), ("A", 2, 11 * day), ("A", 3, 12 * day), ("A", 4, 13 * day), ("A", 5, 100 * day), ("A", 6, 200 * day)]
    lineups = {1: range(5), 2: [0, 1, 2, 3, 7], 3: None, 4: None, 5: None, 6: [5, 6, 7]}

    class Case(Tables):
        def team_rows(self):
            return spark.createDataFrame([(t, c, s, "g") for t, c, s in rows], "team string, contest_id long, ts long, group_id string")

        def appearances(self):
            more = [(100 + k, "A", e) for k in range(3) for e in range(5)]
            return spark.createDataFrame([(c, "A", e) for c, x in lineups.items() if x for e in x] + more, "contest_id long, team string, entity int")

    got = {r.tournament: (r.games, r.sample, r.overlap, r.weight, r.reason) for r in evidence.accepted(Case(spark, "")).collect()}
    assert got == {"g|1970-01": (4, 2, 4, 0.25, "accepted"), "g|1970-04": (1, None, 0, 0.0, "sample_unavailable"), "g|1970-07": (1, 6, 0, 0.0, "sample_roster_mismatch")}
