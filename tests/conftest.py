from __future__ import annotations

import datetime as dt
import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from wardstat.session import local_session  # noqa: E402
from wardstat.sources.tables import FLAGS, SCHEMAS, ClinicalTables  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = local_session(8, "tests", **{"spark.ui.showConsoleProgress": "false"})
    yield session
    session.stop()


def when(text: str | None):
    return dt.datetime.fromisoformat(text) if text else None


def _flags(**set_flags):
    return [set_flags.get(f, 0) for f in FLAGS]


@pytest.fixture(scope="session")
def ward(spark) -> ClinicalTables:
    """Hand-made tables; every subject shows one edge case."""
    patients = [
        (1, "M", when("1932-02-29"), None),  # leap-day birthday
        (2, "F", when("1950-06-01"), when("2001-01-01")),  # two stays with the same first time
        (3, "M", when("1940-01-01"), None),  # one stay without a time
        (4, "F", when("1890-01-01"), None),  # 96 at admission
        (5, "M", when("1700-01-01"), None),  # 300 at admission
        (6, "F", when("1980-01-01"), None),  # 10 at admission
        (7, "M", when("1960-03-15T12:00:00"), None),  # NULL flag, no score, no diagnosis
        (8, None, when("1970-01-01"), None),  # later stay only counts as later
    ]
    stays = [
        (11, 101, 1, when("1993-02-28T12:00:00"), when("1993-03-02T12:00:00")),
        (21, 102, 2, when("2000-05-01"), when("2000-05-03")),
        (22, 102, 2, when("2000-05-01"), when("2000-05-02")),
        (31, 103, 3, None, when("2000-05-02")),
        (32, 104, 3, when("2000-07-01"), when("2000-07-02")),
        (41, 105, 4, when("1986-01-01"), when("1986-01-11")),
        (51, 106, 5, when("2000-01-01"), when("2000-01-04")),
        (61, 107, 6, when("1990-01-01"), when("1990-01-04")),
        (71, 108, 7, when("2000-03-15T11:59:59"), when("2000-03-16T11:59:59")),
        (81, 109, 8, when("2001-01-01"), when("2001-01-03")),
        (82, 110, 8, when("2002-01-01"), when("2002-01-09")),
    ]
    admissions = [
        (101, 1, when("1993-02-27"), when("1993-03-09"), None, "ELECTIVE"),
        (102, 2, when("2000-05-01"), when("2000-05-06"), when("2000-05-06"), "EMERGENCY"),
        (103, 3, when("2000-05-01"), when("2000-05-06"), None, "URGENT"),
        (104, 3, when("2000-07-01"), when("2000-07-05"), None, "URGENT"),
        (105, 4, when("1986-01-01"), when("1986-01-21"), None, "ELECTIVE"),
        (106, 5, when("2000-01-01"), when("2000-01-05"), None, None),
        (107, 6, when("1990-01-01"), when("1990-01-05"), None, "NEWBORN"),
        (108, 7, when("2000-03-15"), when("2000-03-18"), None, "URGENT"),
        (109, 8, when("2001-01-01"), when("2001-01-05"), None, "ELECTIVE"),
        (110, 8, when("2002-01-01"), when("2002-01-11"), None, "ELECTIVE"),
    ]
    flags = [
        (101, *_flags(hypertension=1, obesity=1)),
        (102, *_flags(hypertension=1)),
        (103, *_flags()),
        (104, *_flags(**{f: 1 for f in FLAGS[:9]})),
        (105, *_flags(depression=1)),
        (106, *_flags()),
        (107, *_flags()),
        (108, *_flags(hypertension=1, obesity=None, depression=1)),
        (109, *_flags()),
        (110, *_flags(aids=1)),
    ]
    sofa = [(s, h, p, s % 13) for s, h, p, _, _ in stays if s != 71]
    oasis = [(h, p, h % 11) for h, p, *_ in admissions]
    angus = [(h, p, h % 2, 0) for h, p, *_ in admissions]
    diagnoses = [(101, "99592"), (101, "4019"), (102, "78552"), (102, "78552"), (104, "4019"), (109, None)]
    rows = {
        "patients": patients,
        "icustays": stays,
        "admissions": admissions,
        "elixhauser_quan": flags,
        "sofa": sofa,
        "oasis": oasis,
        "angus": angus,
        "diagnoses_icd": diagnoses,
    }
    order = {
        "icustays": ["icustay_id", "hadm_id", "subject_id", "intime", "outtime"],
    }
    assert SCHEMAS["icustays"].names == order["icustays"]
    return ClinicalTables(**{name: spark.createDataFrame(data, SCHEMAS[name]) for name, data in rows.items()})
