"""Native filter operators, written ``column = operator(args)``: relative dates, fiscal periods, text ends,
users and value lists, as predicates on the column. ``now`` is the session's clock."""

from __future__ import annotations

import datetime as dt
import re
from dataclasses import dataclass, field

from ..plans.errors import TSqlError


@dataclass
class Context:
    now: dt.datetime = field(default_factory=dt.datetime.now)
    fiscal_month: int = 1  #: first month of the fiscal year
    fiscal_day: int = 1
    period_months: int = 3
    user: str = "dbo"
    business: str = ""
    teams: tuple = ()
    reports: tuple = ()  #: users below this one
    language: int = 1033


def _add_months(d: dt.datetime, n: int) -> dt.datetime:
    month = d.year * 12 + d.month - 1 + n
    year, month = divmod(month, 12)
    last = (dt.date(year + (month == 11), (month + 1) % 12 + 1, 1) - dt.timedelta(1)).day
    return d.replace(year=year, month=month + 1, day=min(d.day, last))


def _ts(d: dt.datetime) -> str:
    return f"TIMESTAMP_NTZ '{d:%Y-%m-%d %H:%M:%S.%f}'"


def _fiscal_start(c: Context, year: int) -> dt.datetime:
    return dt.datetime(year, c.fiscal_month, c.fiscal_day)


def _fiscal_year(c: Context, d: dt.datetime) -> int:
    return d.year if d >= _fiscal_start(c, d.year) else d.year - 1


def _period(c: Context, year: int, n: int) -> tuple[dt.datetime, dt.datetime]:
    start = _add_months(_fiscal_start(c, year), (n - 1) * c.period_months)
    return start, _add_months(start, c.period_months)


def _current_period(c: Context) -> tuple[int, int]:
    year = _fiscal_year(c, c.now)
    n = 1
    while _period(c, year, n)[1] <= c.now:
        n += 1
    return year, n


def _step(c: Context, year: int, n: int, by: int) -> tuple[dt.datetime, dt.datetime]:
    per = 12 // c.period_months
    at = year * per + n - 1 + by
    return _period(c, at // per, at % per + 1)


def date_range(name: str, args: list, c: Context) -> tuple[dt.datetime | None, dt.datetime | None] | None:
    """[start, end) of a date operator; None as a bound: open. None: no date operator."""
    today = c.now.replace(hour=0, minute=0, second=0, microsecond=0)
    day = dt.timedelta(1)
    week = today - day * ((today.weekday() + 1) % 7)
    month, year = today.replace(day=1), today.replace(month=1, day=1)
    fixed = {
        "yesterday": (today - day, today), "today": (today, today + day), "tomorrow": (today + day, today + 2 * day),
        "lastsevendays": (today - 7 * day, c.now), "nextsevendays": (c.now, today + 8 * day),
        "lastweek": (week - 7 * day, week), "thisweek": (week, week + 7 * day), "nextweek": (week + 7 * day, week + 14 * day),
        "lastmonth": (_add_months(month, -1), month), "thismonth": (month, _add_months(month, 1)), "nextmonth": (_add_months(month, 1), _add_months(month, 2)),
        "lastyear": (_add_months(year, -12), year), "thisyear": (year, _add_months(year, 12)), "nextyear": (_add_months(year, 12), _add_months(year, 24)),
    }
    if name in fixed:
        return fixed[name]
    m = re.fullmatch(r"(last|next|olderthan)x(minutes|hours|days|weeks|months|years)", name)
    if m:
        n = int(args[0])
        hour = c.now.replace(minute=0, second=0, microsecond=0)

        def shifted(d: dt.datetime, k: int) -> dt.datetime:
            if m[2] in ("months", "years"):
                return _add_months(d, k * (12 if m[2] == "years" else 1))
            return d + k * {"minutes": dt.timedelta(minutes=1), "hours": dt.timedelta(hours=1), "days": day, "weeks": 7 * day}[m[2]]

        if m[1] == "olderthan":
            return None, shifted(c.now, -n)
        start = hour if m[2] == "hours" else today
        if m[1] == "last":
            return shifted(start, -n), c.now
        return c.now, (shifted(start, n) + (dt.timedelta(hours=1) if m[2] == "hours" else day))
    if name in ("on", "onorbefore", "onorafter"):
        d = dt.datetime.fromisoformat(str(args[0])[:10])
        return {"on": (d, d + day), "onorbefore": (None, d + day), "onorafter": (d, None)}[name]
    fy = _fiscal_year(c, c.now)
    years = {"thisfiscalyear": 0, "lastfiscalyear": -1, "nextfiscalyear": 1}
    if name in years:
        return _fiscal_start(c, fy + years[name]), _fiscal_start(c, fy + years[name] + 1)
    periods = {"thisfiscalperiod": 0, "lastfiscalperiod": -1, "nextfiscalperiod": 1}
    if name in periods:
        return _step(c, *_current_period(c), periods[name])
    if name in ("lastxfiscalyears", "nextxfiscalyears"):
        n = int(args[0])
        return (_fiscal_start(c, fy - n), _fiscal_start(c, fy)) if name[0] == "l" else (_fiscal_start(c, fy + 1), _fiscal_start(c, fy + 1 + n))
    if name in ("lastxfiscalperiods", "nextxfiscalperiods"):
        n, here = int(args[0]), _current_period(c)
        return (_step(c, *here, -n)[0], _step(c, *here, 0)[0]) if name[0] == "l" else (_step(c, *here, 1)[0], _step(c, *here, n)[1])
    if name == "infiscalyear":
        return _fiscal_start(c, int(args[0])), _fiscal_start(c, int(args[0]) + 1)
    if name in ("infiscalperiodandyear", "inorbeforefiscalperiodandyear", "inorafterfiscalperiodandyear"):
        low, high = _period(c, int(args[1]), int(args[0]))
        return {"infiscalperiodandyear": (low, high), "inorbeforefiscalperiodandyear": (None, high), "inorafterfiscalperiodandyear": (low, None)}[name]
    return None


NAMES = set(
    """yesterday today tomorrow lastsevendays nextsevendays lastweek thisweek nextweek lastmonth thismonth nextmonth lastyear thisyear nextyear
    on onorbefore onorafter thisfiscalyear lastfiscalyear nextfiscalyear thisfiscalperiod lastfiscalperiod nextfiscalperiod lastxfiscalyears
    nextxfiscalyears lastxfiscalperiods nextxfiscalperiods infiscalyear infiscalperiod infiscalperiodandyear inorbeforefiscalperiodandyear
    inorafterfiscalperiodandyear equserid neuserid eqbusinessid nebusinessid equserteams equseroruserteams equseroruserhierarchy
    equseroruserhierarchyandteams equserlanguage beginswith notbeginwith endswith notendwith containvalues notcontainvalues""".split()
) | {f"{a}x{b}" for a in ("last", "next", "olderthan") for b in ("minutes", "hours", "days", "weeks", "months", "years")}
HIERARCHY = {"under", "eqorunder", "notunder", "above", "eqorabove"}


def predicate(name: str, column: str, args: list[str], values: list, c: Context) -> str:
    """args: the arguments as SQL; values: as Python values where they are literals."""
    found = date_range(name, values, c)
    if found:
        low, high = found
        parts = [f"{column} {op} {_ts(d)}" for op, d in ((">=", low), ("<", high)) if d is not None]
        return f"({' AND '.join(parts)})"
    text = lambda xs: ", ".join("'" + str(x).replace("'", "\\'") + "'" for x in xs) or "NULL"
    if name == "infiscalperiod":
        per = 12 // c.period_months
        start = f"(month({column}) - {c.fiscal_month} + 12) % 12"
        if not 1 <= int(values[0]) <= per:
            raise TSqlError(f"There is no fiscal period {values[0]}.", 241)
        return f"(({start}) div {c.period_months} + 1 = {int(values[0])})"
    simple = {
        "beginswith": "startswith({c}, {a})", "notbeginwith": "({c} IS NULL OR NOT startswith({c}, {a}))",
        "endswith": "endswith({c}, {a})", "notendwith": "({c} IS NULL OR NOT endswith({c}, {a}))",
    }
    if name in simple:
        return simple[name].format(c=column, a=args[0])
    if name in ("containvalues", "notcontainvalues"):
        own = f"transform(split(CAST({column} AS string), ','), x -> trim(x))"
        hit = f"arrays_overlap({own}, array({', '.join(f'CAST({a} AS string)' for a in args)}))"
        return hit if name == "containvalues" else f"({column} IS NULL OR NOT {hit})"
    people = {
        "equserid": f"{column} = {text([c.user])}", "neuserid": f"({column} IS NULL OR {column} <> {text([c.user])})",
        "eqbusinessid": f"{column} = {text([c.business])}", "nebusinessid": f"({column} IS NULL OR {column} <> {text([c.business])})",
        "equserteams": f"{column} IN ({text(c.teams)})", "equseroruserteams": f"{column} IN ({text([c.user, *c.teams])})",
        "equseroruserhierarchy": f"{column} IN ({text([c.user, *c.reports])})", "equseroruserhierarchyandteams": f"{column} IN ({text([c.user, *c.reports, *c.teams])})",
        "equserlanguage": f"{column} = {c.language}",
    }
    if name not in people:
        raise TSqlError(f"'{name}' is not a recognized operator.", 195)
    return f"({people[name]})"
