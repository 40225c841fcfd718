"""The whole run against a plain sequential matcher, row by row in one list, on every row of a table."""

import math
import re
from collections import Counter, defaultdict
from itertools import combinations
from types import SimpleNamespace as Row

import pytest
from pyspark.sql import functions as F

from ledgerloom.functions.times import to_ms
from ledgerloom.operators import diagnosis, matching, report
from ledgerloom.plans import ledgers
from ledgerloom.plans import params as P

MIN, DAY = 60_000, 86_400_000
SF = "/root/testdata/sf0.001"


def cents(x):
    return math.floor(x * 100 + 0.5) / 100


def edit(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def key(s):
    return " ".join(t for t in re.split("[^a-z]+", (s or "").lower()) if len(t) >= 2)


def user_key(s):
    return re.sub("[^a-z0-9]+", "", (s or "").lower())


def resembles(user, holder):
    runs = re.findall("[a-z]+", (user or "").lower())
    runs += ["".join(runs)] if len(runs) > 1 else []
    for r in (r for r in runs if len(r) >= 4):
        for w in (w for w in key(holder).split() if len(w) >= 3):
            long = len(r) >= 5
            if w.startswith(r) or r.startswith(w) or (long and r in w) or (long and min(edit(r, w[: len(r)]), edit(r, w[: len(r) + 1])) <= 1):
                return True
            if len(w) >= 5 and ((len(r) > len(w) and w in r) or (len(r) == 4 and edit(r, w[:5]) == 1 and r[0] == w[0])):
                return True
    return False


class Plain:
    """Everything in its order, one at a time."""

    def __init__(self, panel, wallet, params):
        self.p, self.w, self.o = sorted(panel, key=lambda r: (r.ms, r.id)), sorted(wallet, key=lambda r: (r.ms, r.id)), params
        self.used, self.matches, self.known = set(), [], defaultdict(set)

    def free(self, rows):
        return [r for r in rows if r.id not in self.used and r.type in P.MATCHABLE]

    def relation(self, p, w):
        if not w.party:
            return None
        names, k = self.known[user_key(p.party)], key(w.party)
        for n in names:
            short, long = sorted((n, k), key=len)
            if n == k or (" " in short and len(short) >= 8 and long.startswith(short)):
                return "known"
        return "hint" if resembles(p.party, w.party) else "different" if len(names) == 1 else None

    def bonus(self, p, w):
        if abs(p.amount - w.amount) <= self.o.amount_tolerance:
            return 0
        if p.type == "COLLECT":
            return next((b for b in self.o.bonuses if abs(p.amount - cents(w.amount * (1 + b / 100))) <= self.o.amount_tolerance + w.amount * 0.001), None)
        return None

    def most(self, kind):
        return (self.o.max_collect_lag if kind == "COLLECT" else self.o.max_payout_lag) * MIN

    @staticmethod
    def lag(p, w):
        return p.ms - w.ms if p.type == "COLLECT" else w.ms - p.ms

    def take(self, ps, ws, status, conf, timed=True):
        self.used |= {r.id for r in [*ps, *ws]}
        collect = ps[0].type == "COLLECT"
        lag = max(p.ms for p in ps) - min(w.ms for w in ws) if collect else max(w.ms for w in ws) - min(p.ms for p in ps)
        self.matches.append((tuple(p.id for p in ps), tuple(w.id for w in ws), status, conf, lag if timed else None))

    def learn(self):
        by = {r.id: r for r in self.p + self.w}
        for ps, ws, _, conf, _ in self.matches:
            if len(ps) == len(ws) == 1 and conf == "high" and by[ws[0]].party:
                self.known[user_key(by[ps[0]].party)].add(key(by[ws[0]].party))

    def pairs(self, safe=False, inverted=False):
        out, ws = [], [w for w in self.free(self.w) if not w.no_time]
        for p in self.free(self.p):
            for w in ws:
                if w.type != p.type:
                    continue
                lag, low, high = self.lag(p, w), -self.o.clock_tolerance * MIN if inverted else 0, -1 if inverted else self.most(p.type)
                if low <= lag <= high and (b := self.bonus(p, w)) is not None:
                    rel = self.relation(p, w)
                    if inverted and rel == "different":
                        continue
                    points = 100 - abs(lag) / MIN - (5 if lag < 0 else 0) - (15 if b else 0) + {"known": 60, "hint": 25, "different": -45, None: 0}[rel]
                    out.append((points, p, w, b, rel))
        n_p, n_w = Counter(x[1].id for x in out), Counter(x[2].id for x in out)
        for points, p, w, b, rel in sorted(out, key=lambda x: (-x[0], x[1].ms, x[1].id, x[2].ms, x[2].id)):
            sure = rel in ("known", "hint") or n_p[p.id] == n_w[w.id] == 1
            if p.id in self.used or w.id in self.used or ((safe or inverted) and (not sure or rel == "different")):
                continue
            graded = "high" if points >= 85 else "medium"
            conf = "low" if inverted or rel == "different" else "high" if rel == "known" else graded if rel == "hint" or b == 0 else "medium"
            self.take([p], [w], P.MATCHED_BONUS if b else P.MATCHED, conf)

    def groups(self):
        fits = lambda p, w: p.type == w.type and 0 <= self.lag(p, w) <= self.most(p.type)
        ws = [w for w in self.free(self.w) if not w.no_time]
        for p in self.free(self.p):
            near = [w for w in ws if w.id not in self.used and fits(p, w)]
            ok = lambda a, b: abs(a.amount + b.amount - p.amount) <= self.o.amount_tolerance and (not a.party or not b.party or key(a.party) == key(b.party)) and self.relation(p, a) != "different"  # noqa: B023, E731
            if hit := next((x for x in combinations(near, 2) if ok(*x)), None):
                self.take([p], list(hit), P.GROUPED, "medium")
        for w in ws:
            if w.id in self.used:
                continue
            near = [p for p in self.free(self.p) if fits(p, w)]
            if hit := next((x for x in combinations(near, 2) if abs(x[0].amount + x[1].amount - w.amount) <= self.o.amount_tolerance and user_key(x[0].party) == user_key(x[1].party)), None):
                self.take(list(hit), [w], P.GROUPED, "medium")
        sign = lambda r: r.amount if r.type == "COLLECT" else -r.amount
        reach = max(self.o.max_collect_lag, self.o.max_payout_lag) * MIN
        for w in ws:
            if w.id in self.used or not w.party:
                continue
            near = [p for p in self.free(self.p) if abs(p.ms - w.ms) <= reach and self.relation(p, w) in ("known", "hint")]
            if hit := next((x for x in combinations(near, 2) if x[0].type != x[1].type and user_key(x[0].party) == user_key(x[1].party) and abs(sum(map(sign, x)) - sign(w)) <= self.o.amount_tolerance), None):
                self.take(list(hit), [w], P.NETTED, "medium")

    def in_day(self, p, w):
        start, tol = w.ms - w.ms % DAY, self.o.clock_tolerance * MIN
        low, high = (start - tol, start + DAY + self.most("COLLECT")) if p.type == "COLLECT" else (start - self.most("PAYOUT"), start + DAY + tol)
        return p.type == w.type and low <= p.ms < high

    def timeless(self):
        out = []
        for w in (w for w in self.free(self.w) if w.no_time):
            for p in self.free(self.p):
                if self.in_day(p, w) and (b := self.bonus(p, w)) is not None:
                    rel = self.relation(p, w)
                    out.append((100 + {"known": 60, "hint": 25, "different": -45, None: 0}[rel] - (15 if b else 0), p, w, b, rel))
        g_p, g_w = defaultdict(set), defaultdict(set)
        for _, p, w, _, _ in out:
            g_p[p.id].add((key(w.party), w.amount, w.type))
            g_w[w.id].add((user_key(p.party), p.amount, p.type))
        for _, p, w, b, rel in sorted(out, key=lambda x: (-x[0], x[2].ms, x[2].id, x[1].ms, x[1].id)):
            alone = len(g_p[p.id]) == len(g_w[w.id]) == 1
            if p.id not in self.used and w.id not in self.used and (rel in ("known", "hint") or alone):
                self.take([p], [w], P.MATCHED_BONUS if b else P.MATCHED, {"known": "high", "hint": "medium"}.get(rel, "low"), timed=False)

    def series(self):
        groups = defaultdict(list)
        for w in self.free(self.w):
            if w.no_time and w.party:
                groups[key(w.party), w.amount, w.type, w.ms // DAY].append(w)
        for ws in sorted(groups.values(), key=lambda g: (-len(g), g[0].ms, g[0].id)):
            users = defaultdict(list)
            for p in self.free(self.p):
                if len(ws) >= 3 and p.party and abs(p.amount - ws[0].amount) <= self.o.amount_tolerance and self.in_day(p, ws[0]) and self.relation(p, ws[0]) != "different":
                    users[user_key(p.party)].append(p)
            order = sorted(users.items(), key=lambda u: (-len(u[1]), u[1][0].ms, u[0]))
            if order and len(order[0][1]) >= max(3, len(ws) - 1) and (len(order) < 2 or len(order[1][1]) <= max(1, len(ws) // 3)):
                for p, w in zip(order[0][1], ws, strict=False):
                    self.take([p], [w], P.MATCHED, "medium", timed=False)

    def run(self):
        for safe in (True, False):
            self.pairs(safe=safe)
            self.known.clear()
            self.learn()
        self.pairs(inverted=True)
        self.groups()
        self.timeless()
        self.series()
        return self

    def alone(self):
        """id: status of what is left."""
        out, void, left = {}, set(), [p for p in self.p if p.id not in self.used]
        ops = [p for p in left if p.type in P.MATCHABLE and p.party]
        for a in ops:
            twin = None if a.id in void else next((b for b in ops if b.id not in void and b.id != a.id and b.type != a.type and 0 <= b.ms - a.ms <= self.o.void_window * MIN and abs(a.amount - b.amount) <= self.o.amount_tolerance and user_key(a.party) == user_key(b.party) and user_key(a.account) == user_key(b.account)), None)
            if twin:
                void |= {a.id, twin.id}
        for p in left:
            out[p.id] = P.PANEL_VOID if p.id in void else p.type if p.type not in P.MATCHABLE else P.CHIPS_NO_COLLECT if p.type == "COLLECT" else P.WITHDRAWAL_NO_PAYOUT
        loose = [w for w in self.w if w.id not in self.used]
        for w in loose:
            same = lambda o: o.id != w.id and o.type == "PAYOUT" and abs(o.amount - w.amount) <= self.o.amount_tolerance and key(o.party) == key(w.party) and abs(o.ms - w.ms) <= self.o.duplicate_window * MIN  # noqa: B023, E731
            twice = w.type == "PAYOUT" and not w.no_time and w.party and (any(same(o) for o in self.w if o.id in self.used) or any(same(o) and o.ms < w.ms for o in loose))
            out[w.id] = P.DUPLICATE_PAYOUT if twice else w.type if w.type not in P.MATCHABLE else P.COLLECT_NO_CHIPS if w.type == "COLLECT" else P.PAYOUT_NO_WITHDRAWAL
        return out

    def reasons(self, status):
        by = {r.id: r for r in self.p + self.w}
        real = {i for i, s in status.items() if s in diagnosis.ACTIONABLE}
        loose = {True: [r for r in self.p if r.id in status], False: [r for r in self.w if r.id in status]}
        spans = {}
        for panel, rows in ((True, self.p), (False, self.w)):
            edges, whole = defaultdict(list), []
            for r in rows:
                if r.no_time and not panel:
                    whole.append((r.ms - r.ms % DAY, r.ms - r.ms % DAY + DAY))
                elif not r.no_time:
                    edges[r.account, r.ms // DAY].append(r.ms)
            spans[panel] = whole + [(min(x) - 30 * MIN, max(x) + 30 * MIN) for x in edges.values()]
        out = {}
        for i in real:
            r, panel = by[i], by[i] in self.p
            near = [o for o in loose[not panel] if o.id in real and o.type == r.type and abs(o.amount - r.amount) <= self.o.amount_tolerance and (abs(o.ms - r.ms) < DAY if o.no_time or r.no_time else abs(o.ms - r.ms) <= 180 * MIN)]
            covered = any(a <= r.ms < b for a, b in spans[not panel])
            out[i] = diagnosis.POSSIBLE_PAIR if near else diagnosis.NO_PANEL_COVERAGE if not panel and not r.no_time and not covered else diagnosis.NO_WALLET_COVERAGE if panel and not covered else diagnosis.NO_SUCH_AMOUNT
        return out


def rows_of(df, side):
    own = matching.movements(df, side).select("id", "type", "party", "account", "amount", "no_time", "ms")
    return [Row(**r.asDict()) for r in own.collect()]


@pytest.fixture(scope="module")
def both(spark):
    # a day in every few, so that the plain loops end soon, and denser days than the table's
    days = lambda df: df.withColumn("ts", F.expr("make_dt_interval(0, 0, 0, (unix_seconds(cast(ts as timestamp)) % 172800) - 86400) + timestamp_ntz'2025-03-02 00:00:00'"))
    return days(ledgers.panel(spark, SF)), days(ledgers.wallet(spark, SF))


def test_the_run_equals_a_plain_one(spark, both):
    panel, wallet = both
    got = matching.reconcile(panel, wallet)
    plain = Plain(rows_of(panel, "panel"), rows_of(wallet, "wallet"), P.Params()).run()
    mine = {(tuple(sorted(r.panel_ids)), tuple(sorted(r.wallet_ids)), r.status, r.confidence, r.lag_ms) for r in got["matches"].collect()}
    want = {(tuple(sorted(p)), tuple(sorted(w)), s, c, lag) for p, w, s, c, lag in plain.matches}
    assert mine == want and len(want) > 300 and {x[2] for x in want} >= {P.MATCHED, P.MATCHED_BONUS, P.GROUPED, P.NETTED}
    status = plain.alone()
    full = diagnosis.diagnose(got["pending"], got["panel"], got["wallet"], tolerance=P.Params().amount_tolerance)
    shown = {r.id: (r.status, r.reason) for r in full.collect()}
    reasons = plain.reasons(status)
    assert shown == {i: (s, reasons.get(i)) for i, s in status.items()}
    # the days' figures from the plain lists
    days = {r.op_day: r for r in report.daily(got["panel"], got["wallet"], got["matches"], got["pending"]).collect()}
    by, day = {r.id: r for r in plain.p + plain.w}, lambda ms: (ms - 6 * 3_600_000) // DAY
    of = {}
    for ps, ws, *_ in plain.matches:
        first = min(by[i].ms for i in ps)
        of |= dict.fromkeys((*ps, *ws), day(first))
    sums, resolved = Counter(), Counter()
    for r in plain.p + plain.w:
        side = "panel" if r in plain.p else "wallet"
        sums[of.get(r.id, day(r.ms)), side, r.type] += r.amount
        resolved[of.get(r.id, day(r.ms))] += side == "panel" and (r.id in plain.used or status.get(r.id) == P.PANEL_VOID)
    import datetime as dt

    for d, r in days.items():
        at = None if d is None else (d - dt.date(1970, 1, 1)).days
        total = lambda side, kind: sum(v for k, v in sums.items() if k[1:] == (side, kind) and at in (None, k[0]))  # noqa: B023, E731
        assert r.panel_collects == pytest.approx(total("panel", "COLLECT")) and r.wallet_payouts == pytest.approx(total("wallet", "PAYOUT"))
        assert r.n_resolved == sum(v for k, v in resolved.items() if at in (None, k))


@pytest.mark.parametrize("size", [1, 7, 10_000])
def test_greedy_in_parts(spark, size):
    import random

    from ledgerloom.operators.joins import greedy_match

    rnd = random.Random(size)
    rows = list({(f"p{t + rnd.randint(-3, 3)}", f"w{t + rnd.randint(-3, 3)}", f"z{t}" if rnd.random() < 0.2 else None): (rnd.randint(0, 20), t * 1000) for t in range(120) for _ in range(4)}.items())
    df = spark.createDataFrame([(*k, *v, "x") for k, v in rows], "a string, b string, c string, score int, at long, extra string").repartition(5)
    order = [-F.col("score"), F.col("a"), F.col("b"), F.col("c")]
    got = {(r.a, r.b, r.c) for r in greedy_match(df, ["a", "b", "c"], order, at="at", size=size).collect()}
    used, want = set(), set()
    for ends, _ in sorted(rows, key=lambda x: (-x[1][0], x[0][0], x[0][1], x[0][2] is not None, x[0][2] or "")):
        mine = {e for e in ends if e}
        if not mine & used:
            used |= mine
            want.add(ends)
    assert got == want
    assert greedy_match(df.limit(0), ["a", "b"], order, at="at").count() == 0
    assert to_ms(F.lit(None).cast("timestamp_ntz")) is not None
