"""T-SQL scalar functions as Spark SQL text. Each takes the argument texts and their types."""

from __future__ import annotations

import re

from ..plans.errors import TSqlError
from ..plans.types import DATES, INTEGERS, base, common

#: Date parts and their abbreviations.
PARTS = {
    "year": ("year", "yy", "yyyy"), "quarter": ("quarter", "qq", "q"), "month": ("month", "mm", "m"), "dayofyear": ("dayofyear", "dy", "y"),
    "day": ("day", "dd", "d"), "week": ("week", "wk", "ww"), "weekday": ("weekday", "dw", "w"), "hour": ("hour", "hh"), "minute": ("minute", "mi", "n"),
    "second": ("second", "ss", "s"), "millisecond": ("millisecond", "ms"), "microsecond": ("microsecond", "mcs"), "nanosecond": ("nanosecond", "ns"),
    "iso_week": ("iso_week", "isowk", "isoww"), "tzoffset": ("tzoffset", "tz"),
}
_PART = {short: name for name, group in PARTS.items() for short in group}


def date_part(word: str) -> str:
    if word.lower() not in _PART:
        raise TSqlError(f"'{word}' is not a recognized datepart option.", 155)
    return _PART[word.lower()]


def quoted(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def text_of(sql: str) -> str | None:
    """The value of a string literal, else None."""
    return re.sub(r"\\(.)", r"\1", sql[1:-1]) if re.fullmatch(r"'(?:[^'\\]|\\.)*'", sql, re.S) else None


def _like_set(inner: str) -> str:
    """What stands in [ ]: characters and ranges, none of them where ^ comes first. An empty set, or a
    range from a later to an earlier character, matches nothing."""
    negated = inner.startswith("^")
    own, i, out = inner[negated:], 0, ""
    escaped = lambda c: re.sub(r"[\\\[\]&~^-]", lambda m: "\\" + m[0], c)
    while i < len(own):
        if own[i + 1 : i + 2] == "-" and i + 2 < len(own):
            if own[i] <= own[i + 2]:
                out += f"{escaped(own[i])}-{escaped(own[i + 2])}"
            i += 3
        else:
            out += escaped(own[i])
            i += 1
    if not out:
        return "[\\s\\S]" if negated and own else "[^\\s\\S]"
    return f"[{'^' if negated else ''}{out}]"


def like_regex(pattern: str, escape: str | None = None) -> str:
    """A LIKE pattern, with [sets], as a regular expression for the whole text."""
    out, i = "", 0
    while i < len(pattern):
        c = pattern[i]
        if escape and c == escape and i + 1 < len(pattern):
            out += re.escape(pattern[i + 1])
            i += 2
            continue
        end = pattern.find("]", i + 2) if c == "[" else -1
        if c == "%":
            out += "[\\s\\S]*"
        elif c == "_":
            out += "[\\s\\S]"
        elif end > 0:
            out += _like_set(pattern[i + 1 : end])
            i = end
        else:
            out += re.escape(c)
        i += 1
    return out


#: Names of months by their first three letters.
MONTHS = ("jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec")
_CLOCK = r"(?:\s+(\d{1,2}(?::\d{2}(?::\d{2}(?:\.\d{1,7})?)?)?)\s*([ap]m)?)?"


def written_date(value: str, order: str = "mdy") -> str | None:
    """A date written with numbers in the order of SET DATEFORMAT, or with a month's name, as ISO text."""
    value = value.strip().lower()
    if re.fullmatch(r"\d{8}", value):
        return f"{value[:4]}-{value[4:6]}-{value[6:]}"
    m = re.fullmatch(r"(\d{1,4})[./-](\d{1,2})[./-](\d{1,4})" + _CLOCK, value)
    if m and len(m[1]) == 4:
        return None  # the year first is read as it is
    if m:
        found = dict(zip(order, m.groups()[:3]))
        year, month, day = found["y"], int(found["m"]), int(found["d"])
    else:
        m = re.fullmatch(r"([a-z]{3,9})\.?\s+(\d{1,2}),?\s+(\d{4})" + _CLOCK, value) or re.fullmatch(r"(\d{1,2})[\s-]+([a-z]{3,9})\.?,?[\s-]+(\d{4})" + _CLOCK, value)
        if not m:
            return None
        name, day = (m[1], m[2]) if m[1].isalpha() else (m[2], m[1])
        if name[:3] not in MONTHS:
            return None
        year, month, day = m[3], MONTHS.index(name[:3]) + 1, int(day)
    year = int(year) + (0 if len(year) > 2 else 2000 if int(year) < 50 else 1900)
    if not (1 <= month <= 12 and 1 <= day <= 31):
        raise TSqlError("Conversion failed when converting date and/or time from character string.", 241)
    clock = ""
    if m[4]:
        parts = m[4].split(":")
        hour = int(parts[0]) % 12 + (12 if m[5] == "pm" else 0) if m[5] else int(parts[0])
        clock = " " + ":".join([f"{hour:02d}", *(parts[1:] or ["00"])])
    return f"{year:04d}-{month:02d}-{day:02d}{clock}"


def date(sql: str, kind: str | None, order: str = "mdy") -> str:
    if base(kind) in DATES:
        return sql
    value = text_of(sql)
    written = written_date(value, order) if value is not None else None
    return f"CAST({quoted(written) if written else sql} AS timestamp_ntz)"


def dateadd(part: str, n: str, d: str, kind: str | None) -> tuple[str, str]:
    part = date_part(part)
    kind = kind if base(kind) in DATES else "datetime2"
    unit = {"dayofyear": "DAY", "weekday": "DAY"}.get(part, part.upper())
    if part == "nanosecond":
        unit, n = "MICROSECOND", f"(({n}) div 1000)"
    out = f"timestampadd({unit}, CAST({n} AS int), {d})"
    if base(kind) == "date":
        if part in ("hour", "minute", "second", "millisecond", "microsecond", "nanosecond"):
            raise TSqlError(f"The datepart {part} is not supported by date function dateadd for data type date.", 9810)
        out = f"CAST({out} AS date)"
    return out, kind


def datediff(part: str, a: str, b: str) -> str:
    """Boundaries of the part that lie between a and b."""
    part = date_part(part)
    day = lambda x: f"CAST({x} AS date)"
    if part in ("day", "dayofyear", "weekday"):
        return f"datediff({day(b)}, {day(a)})"
    if part == "year":
        return f"(year({b}) - year({a}))"
    if part == "quarter":
        return f"((year({b}) - year({a})) * 4 + quarter({b}) - quarter({a}))"
    if part == "month":
        return f"((year({b}) - year({a})) * 12 + month({b}) - month({a}))"
    if part in ("week", "iso_week"):
        start = lambda x: f"date_sub({day(x)}, dayofweek({day(x)}) - 1)"
        return f"CAST(datediff({start(b)}, {start(a)}) div 7 AS int)"
    unit = {"nanosecond": "MICROSECOND"}.get(part, part.upper())
    cut = lambda x: f"date_trunc('{unit}', {x})"
    scale = " * 1000" if part == "nanosecond" else ""
    return f"CAST(timestampdiff({unit}, {cut(a)}, {cut(b)}){scale} AS int)"


def datetrunc(part: str, d: str, kind: str | None) -> tuple[str, str]:
    part = date_part(part)
    kind = kind if base(kind) in DATES else "datetime2"
    target = "date" if base(kind) == "date" else "timestamp_ntz"
    if part == "week":
        return f"CAST(date_sub(CAST({d} AS date), dayofweek({d}) - 1) AS {target})", kind
    unit = {"iso_week": "WEEK", "dayofyear": "DAY"}.get(part, part.upper())
    return f"CAST(date_trunc('{unit}', {d}) AS {target})", kind


def datepart(part: str, d: str) -> str:
    part = date_part(part)
    plain = {"year": "year", "quarter": "quarter", "month": "month", "dayofyear": "dayofyear", "day": "day", "weekday": "dayofweek", "iso_week": "weekofyear", "hour": "hour", "minute": "minute", "second": "second"}
    if part in plain:
        return f"{plain[part]}({d})"
    if part == "week":  # the first week has four days at least; weeks start on Sunday
        wed = f"date_add(date_sub(CAST({d} AS date), dayofweek({d}) - 1), 3)"
        return f"CAST((dayofyear({wed}) - 1) div 7 + 1 AS int)"
    scale = {"millisecond": "1000", "microsecond": "1000000", "nanosecond": "1000000000"}.get(part)
    if scale:
        return f"CAST((extract(SECOND FROM {d}) % 1) * {scale} AS int)"
    return "0"


#: CONVERT styles of dates, as Java patterns. Fixed values.
STYLES = {
    0: "MMM d yyyy h:mma", 100: "MMM d yyyy h:mma", 1: "MM/dd/yy", 101: "MM/dd/yyyy", 2: "yy.MM.dd", 102: "yyyy.MM.dd", 3: "dd/MM/yy", 103: "dd/MM/yyyy",
    4: "dd.MM.yy", 104: "dd.MM.yyyy", 5: "dd-MM-yy", 105: "dd-MM-yyyy", 6: "dd MMM yy", 106: "dd MMM yyyy", 7: "MMM dd, yy", 107: "MMM dd, yyyy",
    8: "HH:mm:ss", 108: "HH:mm:ss", 10: "MM-dd-yy", 110: "MM-dd-yyyy", 11: "yy/MM/dd", 111: "yyyy/MM/dd", 12: "yyMMdd", 112: "yyyyMMdd", 14: "HH:mm:ss:SSS",
    114: "HH:mm:ss:SSS", 20: "yyyy-MM-dd HH:mm:ss", 120: "yyyy-MM-dd HH:mm:ss", 21: "yyyy-MM-dd HH:mm:ss.SSS", 121: "yyyy-MM-dd HH:mm:ss.SSS",
    23: "yyyy-MM-dd", 126: "yyyy-MM-dd'T'HH:mm:ss.SSS", 127: "yyyy-MM-dd'T'HH:mm:ss.SSS",
}


def _json_path(path: str) -> tuple[str, bool]:
    text = text_of(path)
    if text is None:
        return path, False
    strict = text.strip().lower().startswith("strict")
    text = re.sub(r"^\s*(?:lax|strict)\s+", "", text, flags=re.I)
    return quoted(re.sub(r'\."([^"]+)"', r"['\1']", text)), strict


def _json(a: list[str], scalar: bool) -> str:
    path, strict = _json_path(a[1] if len(a) > 1 else "'$'")
    got = f"get_json_object({a[0]}, {path})"
    literal_path = re.fullmatch(r"'(?:[^'\\\\]|\\\\.)*'", path, re.S)
    # the kind of what is there; text may begin with a bracket too
    nested = f"coalesce(schema_of_variant(try_variant_get(try_parse_json({a[0]}), {path}, 'variant')) RLIKE '^(?:ARRAY|OBJECT)', false)" if literal_path else f"ltrim({got}) RLIKE '^[\\\\[{{]'"
    fail = "raise_error('Property cannot be found on the specified JSON path.')" if strict else "NULL"
    keep, drop = (f"NOT ({nested}) AND length({got}) <= 4000", "") if scalar else (nested, "")
    return f"CASE WHEN {keep} THEN {got}{drop} ELSE {fail} END"


def _net_format(fmt: str) -> str | None:
    """A .NET date pattern as a Java one."""
    standard = {"d": "MM/dd/yyyy", "D": "EEEE, MMMM dd, yyyy", "s": "yyyy-MM-dd'T'HH:mm:ss", "M": "MMMM dd", "Y": "MMMM yyyy"}
    fmt = standard.get(fmt, fmt)
    return fmt.replace("dddd", "EEEE").replace("ddd", "EEE").replace("tt", "a").replace("fffffff", "SSSSSSS").replace("fff", "SSS")


#: Culture: thousands and decimal separators, the currency's sign, whether it stands in front, the short date.
CULTURES = {
    "en-us": (",", ".", "$", True, "M/d/yyyy"), "en-gb": (",", ".", "£", True, "dd/MM/yyyy"), "de-de": (".", ",", "€", False, "dd.MM.yyyy"),
    "fr-fr": ("\u202f", ",", "€", False, "dd/MM/yyyy"), "es-es": (".", ",", "€", False, "d/M/yyyy"), "it-it": (".", ",", "€", False, "dd/MM/yyyy"),
}


def _format(a: list[str], t: list) -> str:
    fmt = text_of(a[1]) or ""
    culture = (text_of(a[2]) or "en-us").lower() if len(a) > 2 else "en-us"
    if culture not in CULTURES:
        raise TSqlError(f"The culture parameter '{culture}' provided in the function call is not supported.", 9818)
    group, point, sign, ahead, short = CULTURES[culture]
    if base(t[0]) in DATES:
        return f"date_format({a[0]}, {quoted(short if fmt == 'd' and len(a) > 2 else _net_format(fmt))})"
    money = re.fullmatch(r"[Cc](\d*)", fmt)
    if money or re.fullmatch(r"[Nn]\d*", fmt) and culture != "en-us":
        n = int(fmt[1:] or 2)
        number = f"format_number(abs({a[0]}), {n})"
        if (group, point) != (",", "."):
            number = f"translate({number}, ',.', {quoted(group + point)})"
        whole = number if not money else f"concat({quoted(sign)}, {number})" if ahead else f"concat({number}, {quoted(' ' + sign)})"
        return f"concat(CASE WHEN {a[0]} < 0 THEN '-' ELSE '' END, {whole})"
    m = re.fullmatch(r"([NnFfDdPpXx])(\d*)", fmt)
    if m:
        kind, n = m[1].upper(), int(m[2] or (0 if m[1].upper() in "DX" else 2))
        if kind == "N":
            return f"format_number({a[0]}, {n})"
        if kind == "F":
            return f"replace(format_number({a[0]}, {n}), ',', '')"
        if kind == "D":
            return f"lpad(CAST({a[0]} AS string), greatest({n}, length(CAST({a[0]} AS string))), '0')"
        if kind == "P":
            return f"concat(format_number({a[0]} * 100, {n}), '%')"
        return f"lpad(lower(hex({a[0]})), greatest({n}, length(hex({a[0]}))), '0')"
    return f"format_number({a[0]}, {quoted(fmt)})"


def _round(a: list[str], t: list) -> tuple[str, str]:
    kind = t[0] if t[0] and base(t[0]) != "string" else "float"
    cast = lambda x: f"CAST({x} AS {_back(kind)})"
    if len(a) > 2 and a[2] != "0":
        scale = f"power(CAST(10 AS decimal(38,0)), {a[1]})"
        x = f"CAST({a[0]} AS double) * {scale}"
        return cast(f"(CASE WHEN {a[0]} < 0 THEN ceil({x}) ELSE floor({x}) END) / {scale}"), kind
    return cast(f"round({a[0]}, {a[1]})"), kind


def _back(kind: str) -> str:
    from ..plans.types import spark_type

    return spark_type(kind)


def _same(sql: str, t: list) -> tuple[str, str]:
    kind = t[0] if t[0] and base(t[0]) != "string" else "float"
    return f"CAST({sql} AS {_back(kind)})", kind


def _charindex(a: list[str]) -> str:
    start = f", greatest({a[2]}, 1)" if len(a) > 2 else ""
    return f"locate(lower({a[0]}), lower({a[1]}){start})"


def _patindex(a: list[str]) -> str:
    pattern = text_of(a[0])
    if pattern is None:
        raise TSqlError("PATINDEX needs a literal pattern here.", 40517)
    body = pattern[1:] if pattern.startswith("%") else pattern
    open_end = body.endswith("%")
    regex = "(?i)" + ("" if pattern.startswith("%") else "^") + like_regex(body[:-1] if open_end else body) + ("" if open_end else "$")
    return f"coalesce(regexp_instr({a[1]}, {quoted(regex)}), 0)"


def _trim(a: list[str], options: dict, chars: str | None) -> str:
    where = options.get("where", "BOTH")
    return f"trim({where} {chars or quoted(' ')} FROM {a[0]})"


def _isjson(a: list[str]) -> str:
    kinds = {"VALUE": "", "ARRAY": "^ARRAY", "OBJECT": "^OBJECT", "SCALAR": "^(?!ARRAY|OBJECT)"}
    want = kinds[(text_of(a[1]) or a[1]).upper()] if len(a) > 1 else "^(?:ARRAY|OBJECT)"
    return f"CASE WHEN {a[0]} IS NULL THEN NULL WHEN coalesce(schema_of_variant(try_parse_json({a[0]})) RLIKE '{want}', false) THEN 1 ELSE 0 END"


def _datalength(a: list[str], t: list) -> tuple[str, str]:
    size = {"bigint": 8, "int": 4, "smallint": 2, "tinyint": 1, "bit": 1, "float": 8, "real": 4, "datetime": 8, "datetime2": 8, "date": 3, "money": 8, "smallmoney": 4}.get(base(t[0]))
    if base(t[0]) == "binary":
        return f"octet_length({a[0]})", "int"
    return (f"CASE WHEN {a[0]} IS NULL THEN NULL ELSE {size} END", "int") if size else (f"(length({a[0]}) * 2)", "int")


def _stuff(a: list[str]) -> str:
    s, at, n, new = a
    return f"CASE WHEN {at} <= 0 OR {at} > length({s}) OR {n} < 0 THEN NULL ELSE concat(substring({s}, 1, {at} - 1), coalesce({new}, ''), substring({s}, {at} + {n})) END"


def _replace(a: list[str]) -> str:
    """All occurrences, whatever their case; the pattern is plain text, an empty one changes nothing."""
    plain = f"concat('(?i)\\\\Q', replace({a[1]}, '\\\\E', '\\\\E\\\\\\\\E\\\\Q'), '\\\\E')"
    new = f"replace(replace({a[2]}, '\\\\', '\\\\\\\\'), '$', '\\\\$')"
    return f"CASE WHEN {a[1]} = '' THEN {a[0]} ELSE regexp_replace({a[0]}, {plain}, {new}) END"


#: name: (fewest, most arguments, function of texts and types to text and type)
FUNCTIONS = {
    "LEFT": (2, 2, lambda a, t: (f"left({a[0]}, {a[1]})", "string")),
    "RIGHT": (2, 2, lambda a, t: (f"right({a[0]}, {a[1]})", "string")),
    "REPLACE": (3, 3, lambda a, t: (_replace(a), "string")),
    "LEN": (1, 1, lambda a, t: (f"length(rtrim({a[0]}))", "int")),
    "DATALENGTH": (1, 1, _datalength),
    "SUBSTRING": (3, 3, lambda a, t: (f"substring({a[0]}, greatest({a[1]}, 1), {a[2]})", "string")),
    "LTRIM": (1, 2, lambda a, t: (f"trim(LEADING {a[1] if len(a) > 1 else quoted(' ')} FROM {a[0]})", "string")),
    "RTRIM": (1, 2, lambda a, t: (f"trim(TRAILING {a[1] if len(a) > 1 else quoted(' ')} FROM {a[0]})", "string")),
    "CHARINDEX": (2, 3, lambda a, t: (_charindex(a), "int")),
    "PATINDEX": (2, 2, lambda a, t: (_patindex(a), "int")),
    "CHAR": (1, 1, lambda a, t: (f"CASE WHEN {a[0]} BETWEEN 0 AND 255 THEN chr({a[0]}) END", "string")),
    "NCHAR": (1, 1, lambda a, t: (f"decode(unhex(lpad(hex({a[0]}), 4, '0')), 'UTF-16BE')", "string")),
    "ASCII": (1, 1, lambda a, t: (f"ascii({a[0]})", "int")),
    "UNICODE": (1, 1, lambda a, t: (f"ascii({a[0]})", "int")),
    "UPPER": (1, 1, lambda a, t: (f"upper({a[0]})", "string")),
    "LOWER": (1, 1, lambda a, t: (f"lower({a[0]})", "string")),
    "STUFF": (4, 4, lambda a, t: (_stuff(a), "string")),
    "FORMAT": (2, 3, lambda a, t: (_format(a, t), "string")),
    "FORMATMESSAGE": (1, 20, lambda a, t: (f"format_string({re.sub('%[iu]', '%d', a[0])}{''.join(', ' + x for x in a[1:])})", "string")),
    "COLLATIONPROPERTY": (2, 2, lambda a, t: ("CAST(NULL AS int)", "int")),
    "COALESCE": (1, 99, lambda a, t: (f"coalesce({', '.join(a)})", _fold(t))),
    "NULLIF": (2, 2, lambda a, t: (f"nullif({a[0]}, {a[1]})", t[0])),
    "ISNULL": (2, 2, lambda a, t: (f"coalesce({a[0]}, CAST({a[1]} AS {_back(t[0])}))" if t[0] not in (None, "null") else f"coalesce({a[0]}, {a[1]})", t[0] if t[0] != "null" else t[1])),
    "DAY": (1, 1, lambda a, t: (f"day({date(a[0], t[0])})", "int")),
    "MONTH": (1, 1, lambda a, t: (f"month({date(a[0], t[0])})", "int")),
    "YEAR": (1, 1, lambda a, t: (f"year({date(a[0], t[0])})", "int")),
    "ABS": (1, 1, lambda a, t: (f"abs({a[0]})", t[0])),
    "SIGN": (1, 1, lambda a, t: _same(f"signum({a[0]})", t)),
    "CEILING": (1, 1, lambda a, t: _same(f"ceil({a[0]})", t)),
    "FLOOR": (1, 1, lambda a, t: _same(f"floor({a[0]})", t)),
    "ROUND": (2, 3, _round),
    "JSON_VALUE": (2, 2, lambda a, t: (_json(a, True), "string")),
    "JSON_QUERY": (1, 2, lambda a, t: (_json(a, False), "string")),
    "JSON_PATH_EXISTS": (2, 2, lambda a, t: (f"CASE WHEN {a[0]} IS NULL THEN NULL WHEN try_variant_get(try_parse_json({a[0]}), {_json_path(a[1])[0]}, 'variant') IS NOT NULL THEN 1 ELSE 0 END", "int")),
    "ISJSON": (1, 2, lambda a, t: (_isjson(a), "int")),
    "NEWID": (0, 0, lambda a, t: ("uuid()", "uniqueidentifier")),
    "CREATELOOKUP": (2, 2, lambda a, t: (f"named_struct('logicalname', {a[0]}, 'id', {a[1]})", None)),
    "CREATEELASTICLOOKUP": (3, 3, lambda a, t: (f"named_struct('logicalname', {a[0]}, 'id', {a[1]}, 'partitionid', {a[2]})", None)),
    "SQL_VARIANT_PROPERTY": (2, 2, lambda a, t: (f"typeof({a[0]})" if (text_of(a[1]) or "").lower() == "basetype" else "CAST(NULL AS string)", "string")),
    ".VALUE": (3, 3, lambda a, t: (f"CAST(xpath_string({a[0]}, {a[1]}) AS {_back(text_of(a[2]) or 'string')})", text_of(a[2]))),
    ".QUERY": (2, 2, lambda a, t: (f"array_join(xpath({a[0]}, {a[1]}), '')", "string")),
    # beyond the dialect's own list
    "CONCAT": (1, 99, lambda a, t: (f"concat({', '.join(f'coalesce(CAST({x} AS string), {quoted(str())})' for x in a)})", "string")),
    "CONCAT_WS": (2, 99, lambda a, t: (f"concat_ws({', '.join(a)})", "string")),
    "REVERSE": (1, 1, lambda a, t: (f"reverse({a[0]})", "string")),
    "REPLICATE": (2, 2, lambda a, t: (f"repeat({a[0]}, {a[1]})", "string")),
    "SPACE": (1, 1, lambda a, t: (f"repeat(' ', {a[0]})", "string")),
    "POWER": (2, 2, lambda a, t: _same(f"power({a[0]}, {a[1]})", t)),
    "SQRT": (1, 1, lambda a, t: (f"sqrt({a[0]})", "float")),
    "EXP": (1, 1, lambda a, t: (f"exp({a[0]})", "float")),
    "LOG": (1, 1, lambda a, t: (f"ln({a[0]})", "float")),
    "EOMONTH": (1, 1, lambda a, t: (f"last_day({date(a[0], t[0])})", "date")),
}


def _fold(kinds: list) -> str | None:
    out = None
    for k in kinds:
        out = common(out, k)
    return out


def call(name: str, a: list[str], t: list) -> tuple[str, str | None]:
    found = FUNCTIONS.get(name)
    if not found:
        raise TSqlError(f"'{name}' is not a recognized built-in function name.", 195)
    low, high, emit = found
    if not low <= len(a) <= high:
        raise TSqlError(f"The {name.lower()} function requires {low} argument(s).", 174)
    if name in ("LEFT", "RIGHT", "SUBSTRING", "REPLACE", "STUFF", "UPPER", "LOWER", "LEN", "CHARINDEX") and base(t[0]) in (*INTEGERS, "decimal", "float", "date", "datetime2"):
        a = [f"CAST({a[0]} AS string)", *a[1:]]
    return emit(a, t)
