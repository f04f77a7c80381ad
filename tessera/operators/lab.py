"""Lab values in running text, formulas over them, and the whole evaluation of a request.

Texts are read in Arrow batches, each once for all names; everything after that is joins and expressions. Formulas and rules
are data: a new row is a new formula or rule.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Mapping, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions import formula
from tessera.functions.plain import bare, compatible
from tessera.functions.vocab import BLACK_FACTOR, CKD_EPI, SEX_FACTORS, UNIT_ALIASES
from tessera.operators import rules as RU
from tessera.operators.units import unit_key

_NUMBER = r"(?P<value>\d+(?:[.,]\d+)?)"
_UNIT = r"(?P<unit>%|[a-zμ]+(?:\s?/\s?(?:[0-9a-z.,]*[0-9a-z]))*)?"
_PRESSURE = re.compile(r"(?<![\d.,])(\d{2,3})\s*/\s*(\d{2,3})(?![\d.,])")
#: Words that tell the sex or race of a person, and that two numbers are a blood pressure; without accents.
SEX_WORDS = {"female": ("nu", "female", "woman", "phu nu"), "male": ("nam", "male", "man")}
RACE_WORDS = {"black": ("da den", "black", "african american"), "other": ("khong phai da den", "non-black", "white", "asian")}
PRESSURE_WORDS = ("huyet ap", "blood pressure", "ha")
#: A name whose value and unit repeat those of a longer name in the same text was read from that name's mention.
PART_OF = {"cholesterol": ("LDL_cholesterol", "HDL_cholesterol")}
_UNITS = {unit_key(form): v for k, v in UNIT_ALIASES.items() for form in (k, bare(k))} | {"mg/l": "mg/L", "meq/l": "mEq/L", "u/l": "U/L", "ng/ml": "ng/mL", "pg/ml": "pg/mL"}


def said(text: str, words: Mapping[str, Sequence[str]]) -> str | None:
    """The key of the longest of its words that stands in the folded text by itself."""
    hits = [(len(w), key) for key, ws in words.items() for w in ws if re.search(rf"(?<![a-z0-9]){re.escape(w)}(?![a-z0-9])", text)]
    return max(hits)[1] if hits else None


class Reader:
    """Reads the values of named quantities from one text at a time. ``names``: quantity to its names."""

    def __init__(self, names: Mapping[str, Sequence[str]]):
        self.names = {}
        for quantity, known in names.items():
            forms = sorted({" ".join(bare(compatible(n)).split()) for n in known if n and n.strip()}, key=lambda n: (-len(n), n))
            self.names[quantity] = [(form, self._patterns(form)) for form in forms]

    @staticmethod
    def _patterns(form: str) -> tuple[re.Pattern, re.Pattern]:
        name = r"\s+".join(map(re.escape, form.split(" ")))
        return (
            re.compile(rf"(?<!\w){name}(?!\w)\s*(?:(?:level\s+)?(?:of|is)|=|:|la)?\s*{_NUMBER}\s*{_UNIT}"),
            re.compile(rf"(?<![\w.,]){_NUMBER}\s*{_UNIT}\s*(?<!\w){name}(?!\w)"),
        )

    def __call__(self, text: str | None) -> tuple[dict[str, tuple[float, str | None]], str | None, str | None]:
        """(value and unit of each quantity, sex, race). The longest name decides, a value after the name before one ahead of it."""
        if not text:
            return {}, None, None
        folded = " ".join(bare(compatible(text)).split())
        found: dict[str, tuple[float, str | None]] = {}
        for quantity, names in self.names.items():
            for form, patterns in names:
                match = next((m for p in patterns if form in folded and (m := p.search(folded))), None)
                if match:
                    unit = match["unit"]
                    found[quantity] = (float(match["value"].replace(",", ".")), _UNITS.get(unit_key(unit)) if unit else None)
                    break
        for short, longer in PART_OF.items():
            if short in found and any(found.get(x) == found[short] for x in longer):
                del found[short]
        if said(folded, {"pressure": PRESSURE_WORDS}) and (m := _PRESSURE.search(folded)):
            found["systolic_bp"], found["diastolic_bp"] = (float(m[1]), "mmHg"), (float(m[2]), "mmHg")
        return found, said(folded, SEX_WORDS), said(folded, RACE_WORDS)


def read_texts(texts: DataFrame, names: Mapping[str, Sequence[str]]) -> DataFrame:
    """(request_id, measurements array<struct<name, value, unit>>, sex, race) of each text of (request_id, text).

    Null and empty texts have no measurements. The names go to every task; they are the reference list.
    """
    kind = dict(texts.dtypes)["request_id"]

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        reader = Reader(names)
        for batch in batches:
            done = [reader(t) for t in batch["text"]]
            yield pd.DataFrame({"request_id": batch["request_id"], "measurements": [[{"name": n, "value": v, "unit": u} for n, (v, u) in sorted(d[0].items())] for d in done], "sex": [d[1] for d in done], "race": [d[2] for d in done]})

    return texts.select("request_id", "text").mapInPandas(read, f"request_id {kind}, measurements array<struct<name string, value double, unit string>>, sex string, race string")


_SEX_NAMES, _RACE_NAME = ("sex_factor", "kappa", "alpha", "female_factor"), "race_factor"


def evaluate_formulas(requests: DataFrame, formulas: DataFrame, sex_factors: Mapping[str, float] = SEX_FACTORS) -> DataFrame:
    """(request_id, formula_id, output_name, unit, status, value, missing, assumptions) of each formula that a request asks for.

    requests: (request_id, formula_ids, values MAP<STRING, DOUBLE>, sex, race); formulas: (formula_id, expression, output_name,
    output_unit). Unknown ids are left out, repeated ones count once. ``missing`` names the inputs that are absent, in order;
    a missing race is assumed and the assumption named. Values have four digits. ``status`` is ``computed``,
    ``missing_inputs``, ``error`` or ``invalid``. The sex factor of a formula that ``sex_factors`` lacks is one.
    """
    asked = requests.select("request_id", F.explode(F.array_distinct("formula_ids")).alias("formula_id"), F.coalesce("values", F.create_map().cast("map<string,double>")).alias("values"), "sex", "race")
    known = formulas.groupBy("formula_id").agg(F.max(F.struct("expression", "output_name", "output_unit")).alias("f")).select("formula_id", "f.*")
    both = asked.join(known, "formula_id")
    factor = F.create_map(*(F.lit(x) for pair in sex_factors.items() for x in pair))[F.col("formula_id")]
    female = F.col("sex") == "female"
    pick = lambda name: F.when(female, CKD_EPI["female"][name]).otherwise(CKD_EPI["male"][name])
    by_sex = F.map_from_arrays(F.array(*map(F.lit, _SEX_NAMES)), F.array(F.when(female, F.coalesce(factor, F.lit(1.0))).otherwise(1.0), pick("kappa"), pick("alpha"), pick("female_factor")))
    no_map = F.create_map().cast("map<string,double>")
    by_race = F.create_map(F.lit(_RACE_NAME), F.when(F.col("race") == "black", BLACK_FACTOR).otherwise(1.0))
    given = F.map_filter("values", lambda k, v: ~k.isin(*_SEX_NAMES, _RACE_NAME))
    both = both.withColumn("values", F.map_concat(given, F.when(F.col("sex").isNotNull(), by_sex).otherwise(no_map), by_race))
    assumed = F.when(F.col("race").isNull() & F.col("expression").contains(_RACE_NAME), F.array(F.lit("race=other"))).otherwise(F.array().cast("array<string>"))
    both = both.withColumn("key", F.struct("request_id", "formula_id", "output_name", F.col("output_unit").alias("unit"), assumed.alias("assumptions")))
    done = formula.evaluate_rows(both, "key", "expression", "values")
    missing = F.array_sort(F.array_distinct(F.transform("missing", lambda n: F.when(n.isin(*_SEX_NAMES), "sex").otherwise(n))))
    return done.select("id.request_id", "id.formula_id", "id.output_name", "id.unit", "status", F.round("value", 4).alias("value"), missing.alias("missing"), "id.assumptions")


def layered(*layers: Column) -> Column:
    """Measurements (arrays of name, value, unit) of several layers; the first layer that has a name wins."""
    joined = F.filter(F.concat(*(F.coalesce(layer, F.array().cast("array<struct<name:string,value:double,unit:string>>")) for layer in layers)), lambda m: m.isNotNull() & m["name"].isNotNull() & m["value"].isNotNull())
    return F.aggregate(joined, F.array().cast("array<struct<name:string,value:double,unit:string>>"), lambda done, m: F.when(F.exists(done, lambda d: d["name"] == m["name"]), done).otherwise(F.concat(done, F.array(m))))


def evaluate_requests(requests: DataFrame, names: Mapping[str, Sequence[str]], formulas: DataFrame, rules: DataFrame, outputs: Mapping[str, tuple[str, str]]) -> DataFrame:
    """(request_id, measurements, formula_results, classes, status) of each request: the whole evaluation.

    requests: (request_id, text, measurements, formula_ids, disease), ids unique. Given measurements win over those of the
    text, measured ones over those that a formula gives (``outputs``: output name to (quantity, unit)). Classes are the
    labels of the rules met. ``status`` is ``evaluated``, or ``no_input`` where there is nothing to evaluate.
    """
    read = read_texts(requests, names).withColumnRenamed("measurements", "read")
    base = requests.drop("text").join(read, "request_id").withColumn("measurements", layered(F.col("measurements"), F.col("read"))).drop("read")
    values = F.map_from_entries(F.transform("measurements", lambda m: F.struct(m["name"], m["value"])))
    results = evaluate_formulas(base.select("request_id", "formula_ids", values.alias("values"), "sex", "race"), formulas)
    kinds = F.create_map(*(F.lit(x) for output, pair in outputs.items() for x in (output, pair[0]))) if outputs else F.create_map().cast("map<string,string>")
    units = F.create_map(*(F.lit(x) for output, pair in outputs.items() for x in (output, pair[1]))) if outputs else F.create_map().cast("map<string,string>")
    derived = F.struct(kinds[F.col("output_name")].alias("name"), F.col("value"), units[F.col("output_name")].alias("unit"))
    per_request = results.groupBy("request_id").agg(
        F.array_sort(F.collect_list(F.struct("formula_id", "status", "value"))).alias("formula_results"),
        F.array_sort(F.collect_list(F.when((F.col("status") == "computed") & kinds[F.col("output_name")].isNotNull(), derived))).alias("derived"),
    )
    full = base.join(per_request, "request_id", "left").withColumn("measurements", layered(F.col("measurements"), F.col("derived")))
    flat = full.select("request_id", "disease", F.explode("measurements").alias("m")).select("request_id", F.col("m.name").alias("biomarker"), "m.value", "m.unit", "disease")
    met = RU.evaluate_rules(flat, rules).where("matched").groupBy("request_id").agg(F.array_sort(F.collect_set(F.concat_ws("=", "biomarker", "label"))).alias("classes"))
    out = full.join(met, "request_id", "left")
    nothing = (F.size("measurements") == 0) & F.col("formula_results").isNull()
    return out.select("request_id", "measurements", F.coalesce("formula_results", F.array().cast("array<struct<formula_id:string,status:string,value:double>>")).alias("formula_results"), F.coalesce("classes", F.array().cast("array<string>")).alias("classes"), F.when(nothing, "no_input").otherwise("evaluated").alias("status"))
