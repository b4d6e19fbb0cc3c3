"""Metre matching: exact rows from the rule table and a brute-force check."""
import itertools

import regex

from cadenza.operators import metre as M
from cadenza.profiles import METRES


def _regex(template):
    return template  # the templates are plain regular expressions over usUS


def brute_force(template, border, pattern):
    """Enumerate template texts directly (no automaton) with the cut rule."""
    n = len(pattern)
    if n == 0 or n > 20:
        return (0, 0, "", False)
    rx = regex.compile(_regex(template))

    def errs(t):
        s = w = 0
        for tc, c in zip(t, pattern):
            if c == "A":
                continue
            if tc.isupper() and tc != c:
                s += 1
            if tc.islower() and tc != c.lower():
                w += 1
        return s, w

    prev = [("", 0, 0)]
    for i in range(n):
        cur = []
        for t, _, _ in prev:
            for ch in "usUS":
                t2 = t + ch
                if rx.fullmatch(t2, partial=True) is None:
                    continue
                s, w = errs(t2)
                if s + w <= border:
                    cur.append((t2, s, w))
        if not cur:
            ok = [(s, w, t) for t, s, w in prev if "S" in t]
            s, w, t = min(ok) if ok else (0, 0, "")
            return (s + n - i, w, t, True)
        prev = cur
    ok = [(s, w, t) for t, s, w in prev if "S" in t]
    if not ok:
        return (0, 0, "", True)
    s, w, t = min(ok)
    return (s, w, t, False)


def test_fixture_rows(spark):
    rows = [("USUSUSUS",), ("SUSUSUS",), ("AAAAAAAA",), ("A",)]
    df = spark.createDataFrame(rows, "pattern string")
    got = {(r.pattern, r.metre): (r.strong, r.weak, r.failed)
           for r in M.pattern_metre_errors(df).collect()}
    assert got[("USUSUSUS", "iambos")] == (0, 0, False)
    assert got[("SUSUSUS", "choreios")] == (0, 0, False)
    assert got[("AAAAAAAA", "iambos")] == (0, 0, False)
    assert got[("USUSUSUS", "choreios")] == (2, 6, True)
    assert got[("A", "iambos")] == (0, 0, True)


def test_brute_force_small(spark):
    pats = ["".join(p) for n in range(1, 6) for p in itertools.product("SUA", repeat=n)]
    pats += ["UUSUUSUUSU", "SAUSAUSAUS", "AAAAAAAAAAAA", "USUUSUUSUUSUUSUUSUUS", "SSSSSSSS", "UUUUUUUU"]
    df = spark.createDataFrame([(p,) for p in pats], "pattern string")
    got = {(r.pattern, r.metre): (r.strong, r.weak, r.template, r.failed)
           for r in M.pattern_metre_errors(df).collect()}
    got_expr = {(r.pattern, r.metre): (r.strong, r.weak, r.template, r.failed)
                for r in M.pattern_metre_errors(df, engine="expr").collect()}
    assert got == got_expr
    bad = []
    for name, template, border, _, _ in METRES:
        for p in pats:
            exp = brute_force(template, border, p)
            if got[(p, name)] != exp:
                bad.append((name, p, got[(p, name)], exp))
    assert not bad, bad[:10]
