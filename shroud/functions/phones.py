"""International phone numbers by a numbering plan.

A run of digits after ``+`` or ``00`` is read as a trie does: its calling code is the
one prefix of one to three digits that the plan holds (calling codes are prefix-free),
and its national number the longest of the lengths the plan allows there that ends
where a group of digits ends.  What follows in the run is left out of the hit.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Calling codes and the lengths of their national (significant) numbers, as the national numbering plans give them.
PLAN = {
    "1": (10,), "7": (10,), "20": (8, 9, 10), "27": (9,), "30": (10,), "31": (9,), "32": (8, 9), "33": (9,), "34": (9,), "36": (8, 9),
    "39": (6, 7, 8, 9, 10, 11), "40": (9,), "41": (9,), "43": (7, 8, 9, 10, 11, 12, 13), "44": (9, 10), "45": (8,), "46": (7, 8, 9, 10), "47": (8,),
    "48": (9,), "49": (6, 7, 8, 9, 10, 11), "51": (8, 9), "52": (10,), "54": (10, 11), "55": (10, 11), "56": (9,), "57": (8, 10), "58": (10,), "60": (8, 9, 10),
    "61": (9,), "62": (8, 9, 10, 11, 12), "63": (8, 9, 10), "64": (8, 9, 10), "65": (8,), "66": (8, 9), "81": (9, 10), "82": (8, 9, 10), "84": (9, 10), "86": (10, 11),
    "90": (10,), "91": (10,), "92": (9, 10), "94": (9,), "98": (10,), "212": (9,), "213": (8, 9), "216": (8,), "234": (8, 10), "254": (9,), "351": (9,), "352": (6, 8, 9),
    "353": (7, 8, 9), "354": (7,), "356": (8,), "357": (8,), "358": (6, 7, 8, 9, 10, 11), "359": (8, 9), "370": (8,), "371": (8,), "372": (7, 8), "373": (8,), "374": (8,),
    "375": (9,), "380": (9,), "381": (8, 9), "385": (8, 9), "386": (8,), "420": (9,), "421": (9,), "852": (8,), "886": (8, 9), "961": (7, 8), "962": (8, 9), "965": (8,),
    "966": (9,), "971": (8, 9), "972": (8, 9), "974": (8,), "992": (9,), "994": (9,), "995": (9,), "996": (9,), "998": (9,),
}

#: Digits with at most two separators between them; the first ones are the calling code.
RUN = r"(?<![\w+])(?:\+|00)[1-9](?:[ \-./() ]{0,2}[0-9]){5,24}"


def _plan_sql() -> str:
    pairs = ", ".join(f"'{code}', array({', '.join(map(str, sorted(lengths, reverse=True)))})" for code, lengths in sorted(PLAN.items()))
    return f"map({pairs})"


def plan_length(hit: Column) -> Column:
    """How many characters of a run of digits are a phone number; null if none."""
    plan = F.expr(_plan_sql())
    lead = F.when(hit.startswith("+"), 1).otherwise(2)

    def of(z: Column) -> Column:
        digits = F.regexp_replace(F.substring(z["h"], z["lead"] + 1, F.length(z["h"])), "[^0-9]", "")
        codes = F.filter(F.transform(F.array(F.lit(1), F.lit(2), F.lit(3)), lambda n: F.substring(digits, F.lit(1), n)), lambda c: F.call_function("map_contains_key", plan, c))
        # where, after so many digits, the number would end: before another digit it cannot
        ends = F.transform(F.try_element_at(plan, F.get(codes, 0)), lambda n: F.length(F.coalesce(F.regexp_substr(
            z["h"], F.concat(F.lit(r"^(?:\+|00)(?:[^0-9]*[0-9]){"), (F.length(F.get(codes, 0)) + n).cast("string"), F.lit("}(?![0-9])"))), F.lit(""))))
        return F.get(F.filter(ends, lambda e: e > 0), 0)
    return F.transform(F.array(F.struct(hit.alias("h"), lead.alias("lead"))), of)[0]
