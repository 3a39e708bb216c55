"""Format-preserving Feistel pseudonyms.

Personal values are found by one pattern and validated by kind: Luhn numbers, telephone and social security
numbers, IPv4 octets, calendar dates, mail addresses and credentials. A valid value is replaced by a keyed
permutation within its own format: a Feistel network whose halves are strings of symbols, each symbol shifted
within its own alphabet by a keyed digest of the other half. The same value gives the same pseudonym in every
document, so links survive, and the pseudonym is again valid: check digits are computed anew, octets stay below
256, and dates are permuted as day numbers of a fixed span of years.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from granary.llm._common import unused

ROUNDS = 8
#: Kinds in order of precedence with their patterns. Fixed formats.
KINDS = (
    (
        "credential",
        r"(?<![A-Za-z0-9])AKIA[A-Z0-9]{16}(?![A-Za-z0-9])|(?<=password=)[A-Za-z0-9]{8,64}(?![A-Za-z0-9])|(?<=token = \")[A-Za-z0-9]{16,64}(?=\")"
        r"|(?<=(?i:password|passwd|secret|token|api_key)[ ]{0,2}[=:][ ]{0,2}[\"']{0,1})(?=[A-Za-z]{0,63}[0-9])[A-Za-z0-9]{8,64}(?![A-Za-z0-9])",
    ),
    ("mail", r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+"),
    ("ssn", r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])"),
    ("date", r"(?<![0-9./-])(?:[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{2}\.[0-9]{2}\.[0-9]{4}|[0-9]{2}/[0-9]{2}/[0-9]{4})(?![0-9/-])"),
    ("ip", r"(?<![0-9.])[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?![0-9]|\.[0-9])"),
    ("phone", r"(?<![0-9A-Za-z+])(?:\+[0-9]{1,3}[ .-]?)?(?:\([0-9]{3}\)[ .-]?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}(?![0-9])"),
    ("card", r"(?<![0-9A-Za-z.-])[0-9](?:[ -]?[0-9]){12,18}(?![0-9A-Za-z])"),
)
PATTERN = "|".join(f"(?:{p})" for _, p in KINDS)
#: A text without any of these marks has no value of any kind.
MARKS = r"@|AKIA|(?i:password|passwd|secret|token|api_key)[ ]{0,2}[=:]|[0-9][0-9. ()/-]{5}"
#: Dates are permuted within 1900-01-01 to 2099-12-31.
FIRST_DAY, DAYS = "1900-01-01", 73049


def _text(value: str) -> str:
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def feistel(value: str, key: str, kind: str, first: str = "0") -> str:
    """SQL that permutes the letters and digits of a string expression within their classes; the rest stays.

    first: SQL of the place (from 1) of a digit that keeps to 2-9 or 0-1, as the first of an area code does.
    """
    code = "ascii(substring(h.{0}, i, 1))"

    def shifted(side: str, other: str, r: int) -> str:
        stream = f"sha2(concat({_text(f'{key}|{kind}|{r}|')}, length(h.{side}), '|', h.{other}), 512)"
        at = code.format(side)
        k = "cast(conv(substring(q, 2 * ((i - 1) % 64) + 1, 2), 16, 10) AS int)"
        place = "i" if side == "l" else "(i + length(h.l))"
        lead = f"CASE WHEN {at} >= 50 THEN 50 + ({at} - 50 + {k}) % 8 ELSE 48 + ({at} - 48 + {k}) % 2 END"
        symbol = (
            f"CASE WHEN {at} BETWEEN 48 AND 57 THEN char(IF({place} = {first}, {lead}, 48 + ({at} - 48 + {k}) % 10)) "
            f"WHEN {at} BETWEEN 97 AND 122 THEN char(97 + ({at} - 97 + {k}) % 26) WHEN {at} BETWEEN 65 AND 90 THEN char(65 + ({at} - 65 + {k}) % 26) "
            f"ELSE substring(h.{side}, i, 1) END"
        )
        letters = f"IF(length(h.{side}) = 0, '', array_join(transform(sequence(1, length(h.{side})), i -> {symbol}), ''))"
        return f"transform(array({stream}), q -> {letters})[0]"

    half = f"cast(length({value}) / 2 AS int)"
    steps = ", ".join(str(r) for r in range(ROUNDS))
    new_l = "CASE r " + " ".join(f"WHEN {r} THEN {shifted('l', 'r', r)}" for r in range(0, ROUNDS, 2)) + " ELSE h.l END"
    new_r = "CASE r " + " ".join(f"WHEN {r} THEN {shifted('r', 'l', r)}" for r in range(1, ROUNDS, 2)) + " ELSE h.r END"
    return (
        f"aggregate(array({steps}), named_struct('l', substring({value}, 1, {half}), 'r', substring({value}, {half} + 1)), "
        f"(h, r) -> named_struct('l', {new_l}, 'r', {new_r}), h -> concat(h.l, h.r))"
    )


def number_feistel(value: str, a: int, b: int, key: str, kind: str) -> str:
    """SQL that permutes 0 <= value < a * b by a Feistel network over its quotient and remainder."""
    draw = "cast(conv(substring(sha2(concat({k}, '|', {v}), 256), 1, 12), 16, 10) AS bigint)"
    new_l = f"IF(r % 2 = 0, (h.l + {draw.format(k=f'concat({_text(f"{key}|{kind}|")}, r)', v='h.r')}) % {a}, h.l)"
    new_r = f"IF(r % 2 = 1, (h.r + {draw.format(k=f'concat({_text(f"{key}|{kind}|")}, r)', v='h.l')}) % {b}, h.r)"
    steps = ", ".join(str(r) for r in range(ROUNDS))
    return (
        f"aggregate(array({steps}), named_struct('l', cast({value} AS bigint) div {b}, 'r', cast({value} AS bigint) % {b}), "
        f"(h, r) -> named_struct('l', {new_l}, 'r', {new_r}), h -> h.l * {b} + h.r)"
    )


def luhn_sum(digits: str, doubled: int) -> str:
    """SQL: the Luhn sum of a digit string; doubled: 1 if the last digit counts twice."""
    d = f"cast(substring({digits}, length({digits}) - j, 1) AS int)"
    return f"aggregate(sequence(0, length({digits}) - 1), 0, (s, j) -> s + IF(j % 2 = {1 - doubled}, 2 * {d} - IF({d} > 4, 9, 0), {d}))"


def _layout(old: str, digits: str) -> str:
    """SQL: the digits put back where old has digits."""
    return (
        f"aggregate(sequence(1, length({old})), named_struct('s', '', 'n', 1), (a, p) -> IF(substring({old}, p, 1) RLIKE '[0-9]', "
        f"named_struct('s', concat(a.s, substring({digits}, a.n, 1)), 'n', a.n + 1), named_struct('s', concat(a.s, substring({old}, p, 1)), 'n', a.n)), a -> a.s)"
    )


def pseudonym(key: str) -> str:
    """SQL of the pseudonym of the matched string v; a match that is not valid stays as it is."""
    only = "regexp_replace(v, '[^0-9]', '')"
    let = lambda name, value, body: f"transform(array({value}), {name} -> {body})[0]"
    full = {kind: _text("^(?:" + p.split("|(?<=")[0] + ")$") for kind, p in KINDS}
    card_body = let("d", only, let("t", f"concat(substring(d, 1, 1), {feistel('substring(d, 2, length(d) - 2)', key, 'card')})",
                    let("c", f"cast((10 - {luhn_sum('t', 1)} % 10) % 10 AS string)", _layout("v", "concat(t, c)"))))
    card = f"IF({let('d', only, luhn_sum('d', 0) + ' % 10 = 0')}, {card_body}, v)"
    area = "IF(substring(v, 1, 1) = '+', regexp_replace(v, '^([+][0-9]{1,3}[ .-]?)?.*$', '$1'), '')"
    phone = let("c", area, let("t", "substring(v, length(c) + 1)", f"concat(c, {feistel('t', key, 'phone', 'IF(substring(t, 1, 1) = "(", 2, 1)')})"))
    octets = "transform(split(v, '[.]'), x -> cast(x AS bigint))"
    number = "o[0] * 16777216 + o[1] * 65536 + o[2] * 256 + o[3]"
    ip_new = let("n", number_feistel(number, 65536, 65536, key, "ip"), "concat_ws('.', n div 16777216, n div 65536 % 256, n div 256 % 256, n % 256)")
    ip = let("o", octets, f"IF(array_max(o) < 256, {ip_new}, v)")
    ssn_new = let("n", number_feistel("(d[0] - 1 - IF(d[0] > 666, 1, 0)) * 989901 + (d[1] - 1) * 9999 + d[2] - 1", 898 * 99, 9999, key, "ssn"),
                  let("e", "n div 989901 + 1", "concat(lpad(e + IF(e >= 666, 1, 0), 3, '0'), '-', lpad(n div 9999 % 99 + 1, 2, '0'), '-', lpad(n % 9999 + 1, 4, '0'))"))
    ssn = let("d", "transform(split(v, '-'), x -> cast(x AS bigint))", f"IF(d[0] BETWEEN 1 AND 899 AND d[0] <> 666 AND d[1] > 0 AND d[2] > 0, {ssn_new}, v)")
    style = "CASE WHEN v LIKE '%-%' THEN 'yyyy-MM-dd' WHEN v LIKE '%.%' THEN 'dd.MM.yyyy' WHEN cast(substring(v, 1, 2) AS int) > 12 THEN 'dd/MM/yyyy' ELSE 'MM/dd/yyyy' END"
    iso = "CASE WHEN f = 'yyyy-MM-dd' THEN v WHEN f = 'MM/dd/yyyy' THEN concat_ws('-', substring(v, 7), substring(v, 1, 2), substring(v, 4, 2)) ELSE concat_ws('-', substring(v, 7), substring(v, 4, 2), substring(v, 1, 2)) END"
    # 271 * 270 = 73,170 is the least such product above 73,049; values past the last day walk on
    day = f"datediff(d, date'{FIRST_DAY}')"
    walk = f"aggregate(sequence(1, 12), cast({day} AS bigint) - {DAYS}, (n, i) -> IF(n < 0 OR n >= {DAYS}, IF(i = 1, {number_feistel(f'(n + {DAYS})', 271, 270, key, 'date')}, {number_feistel('n', 271, 270, key, 'date')}), n))"
    stamp = "CASE WHEN f = 'yyyy-MM-dd' THEN cast(e AS string) WHEN f = 'MM/dd/yyyy' THEN concat_ws('/', substring(cast(e AS string), 6, 2), substring(cast(e AS string), 9, 2), substring(cast(e AS string), 1, 4)) WHEN f = 'dd/MM/yyyy' THEN concat_ws('/', substring(cast(e AS string), 9, 2), substring(cast(e AS string), 6, 2), substring(cast(e AS string), 1, 4)) ELSE concat_ws('.', substring(cast(e AS string), 9, 2), substring(cast(e AS string), 6, 2), substring(cast(e AS string), 1, 4)) END"
    date = let("f", style, let("d", f"try_cast({iso} AS date)", f"IF(d BETWEEN date'{FIRST_DAY}' AND date'2099-12-31', {let('e', f"date_add(date'{FIRST_DAY}', cast({walk} AS int))", stamp)}, v)"))
    mail = let("c", "substring_index(v, '@', 1)", f"concat({feistel('c', key, 'mail')}, substring(v, length(c) + 1))")
    credential = f"IF(v LIKE 'AKIA%', concat('AKIA', {feistel('substring(v, 5)', key, 'credential')}), {feistel('v', key, 'credential')})"
    return (
        f"CASE WHEN v RLIKE {full['mail']} THEN {mail} WHEN v RLIKE {full['ssn']} THEN {ssn} WHEN v RLIKE {full['date']} THEN {date} "
        f"WHEN v RLIKE {full['ip']} THEN {ip} WHEN v RLIKE {full['phone']} THEN {phone} WHEN v RLIKE {full['card']} THEN {card} ELSE {credential} END"
    )


def pseudonymized(docs: DataFrame, key: str) -> DataFrame:
    """docs (with a text column) with personal values replaced by pseudonyms, and n_private, their number.

    A null text stays null with n_private 0; a text without values stays byte for byte. Equal values get equal
    pseudonyms in all rows; ties and repeated rows are each replaced alike; other columns stay, whatever their names,
    but for one named n_private; no rows give none. The pseudonym of a value is the same in every run with the same
    key, and whoever has the key can turn it back: it must be kept apart from the result.
    """
    hit, found, new = unused(docs, "hit_", "found_", "new_")
    marked = docs.withColumn(hit, F.coalesce(F.rlike("text", F.lit(MARKS)), F.lit(False)))
    matched = marked.withColumn(found, F.when(F.col(hit), F.regexp_extract_all("text", F.lit(PATTERN), F.lit(0))))
    replaced = matched.withColumn(new, F.expr(f"CASE WHEN size({found}) > 0 THEN transform({found}, v -> {pseudonym(key)}) END"))
    parts = F.split("text", PATTERN, -1)
    whole = F.array_join(F.zip_with(parts, F.col(new), lambda p, n: F.concat(p, F.coalesce(n, F.lit("")))), "")
    changed = F.when(F.col(new).isNotNull(), whole).otherwise(F.col("text"))
    private = F.coalesce(F.size(F.filter(F.zip_with(found, new, lambda a, b: a != b), lambda x: x)), F.lit(0)).cast("long")
    kept = [changed.alias("text") if c == "text" else F.col(f"`{c}`") for c in docs.columns if c != "n_private"]
    return replaced.select(*kept, F.when(F.col(new).isNull(), F.lit(0)).otherwise(private).cast("long").alias("n_private"))
