"""Fail-fast registry checks (U3), in Python and as DataFrame set operations."""

import pytest

from shroud import config as C


def ok(**kw):
    return C.Settings(secret="x").with_(**kw)


def test_valid_passes(spark):
    C.validate(ok())
    assert C.registry_violations(spark, ok()).count() == 0


@pytest.mark.parametrize("settings,match,check", [
    (C.Settings(secret=""), "secret", "no_secret"),
    (ok(surrogate_types=C.SURROGATE_TYPES + ("PERSON",)), "overlap", "overlap"),
    (ok(surrogate_types=C.SURROGATE_TYPES + ("FOOBAR",)), "unknown", "unknown"),
    (ok(surrogate_types=("PHONE",)), "not assigned", "missing"),
    (ok(surrogate_types=tuple(t for t in C.SURROGATE_TYPES if t != "PHONE"),
        marker_types=C.MARKER_TYPES + ("PHONE",)), "label", "no_label"),
])
def test_bad_settings(spark, settings, match, check):
    with pytest.raises(C.ConfigError, match=match):
        C.validate(settings)
    checks = {r["check"] for r in C.registry_violations(spark, settings).collect()}
    assert check in checks


def test_stats_types(spark):
    from pyspark.sql import functions as F

    from shroud.sources import store as S
    st = S.stats(S.empty_sessions(spark), F.current_timestamp()).collect()[0]
    assert st["active_sessions"] == 0
    assert {"ACCOUNT", "BIK", "KPP", "PERSON", "PHONE"} <= set(st["supported_entity_types"])
