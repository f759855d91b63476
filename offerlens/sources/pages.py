"""Raw offer pages: envelope, contract check, quarantine, unknown fields."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from offerlens.sources.tables import computed_once

# Fields of the source contract and their JSON types.
TEXT = "string"
OFFER_FIELDS = {
    "id": TEXT, "intitule": TEXT, "description": TEXT, "dateCreation": TEXT, "dateActualisation": TEXT, "lieuTravail": "object",
    "romeCode": TEXT, "romeLibelle": TEXT, "appellationlibelle": TEXT, "entreprise": "object", "typeContrat": TEXT,
    "typeContratLibelle": TEXT, "natureContrat": TEXT, "experienceExige": TEXT, "experienceLibelle": TEXT,
    "experienceCommentaire": TEXT, "complementExercice": TEXT, "formations": "array", "competences": "array", "langues": "array",
    "permis": "array", "salaire": "object", "dureeTravailLibelle": TEXT, "dureeTravailLibelleConverti": TEXT,
    "alternance": "boolean", "contact": "object", "agence": "object", "nombrePostes": "count", "deplacementCode": TEXT,
    "deplacementLibelle": TEXT, "qualificationCode": TEXT, "qualificationLibelle": TEXT, "codeNAF": TEXT, "secteurActivite": TEXT,
    "secteurActiviteLibelle": TEXT, "qualitesProfessionnelles": "array", "trancheEffectifEtab": TEXT, "origineOffre": "object",
    "offresManqueCandidats": "boolean", "contexteTravail": "object", "entrepriseAdaptee": "boolean",
    "employeurHandiEngage": "boolean", "accessibleTH": "boolean",
}
NESTED_FIELDS = {
    "lieuTravail": {"libelle": TEXT, "latitude": (-90, 90), "longitude": (-180, 180), "codePostal": TEXT, "commune": TEXT},
    "entreprise": {"nom": TEXT, "description": TEXT, "entrepriseAdaptee": "boolean"},
    "salaire": {"libelle": TEXT, "commentaire": TEXT, "complement1": TEXT, "complement2": TEXT},
    "origineOffre": {"origine": TEXT, "urlOrigine": TEXT},
    "contexteTravail": {"horaires": "string_or_strings"},
}
ITEM_FIELDS = {"langues": ("libelle", "exigence"), "permis": ("libelle", "exigence")}
MANDATORY = ("id", "intitule", "description")
ROOT_FIELDS = ("resultats", "filtresPossibles")
MASKED_FIELD = "[invalid-field-name]"

PAGE_SCHEMA = "query_key string, range_start long, payload string"


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    """Landed pages, one JSON line each with its query, range start and the payload as text."""
    return spark.read.schema(PAGE_SCHEMA).json(path)


# An escape is real only after an even number of backslashes; a high surrogate must be followed by a low one.
_ESCAPE = r"(?<!\\)((?:\\\\)*)\\u"
_NUL = _ESCAPE + "0000"
_LONE_HIGH = _ESCAPE + r"[dD][89abAB][0-9a-fA-F]{2}(?!\\u[dD][c-fC-F])"
_LONE_LOW = r"(?<!\\u[dD][89abAB][0-9a-fA-F]{2})" + _ESCAPE + "[dD][c-fC-F][0-9a-fA-F]{2}"
# Two noncharacters stand for text that cannot be stored, since a parser would silently lose it.
UNSTORABLE = "\ufdd1\ufdd2"


def _flagged(payload: Column) -> Column:
    """Raw JSON text with the escapes of NUL and of lone surrogates replaced by a mark."""
    flagged = payload
    for pattern in (_NUL, _LONE_HIGH, _LONE_LOW):
        flagged = F.regexp_replace(flagged, pattern, "$1" + UNSTORABLE)
    return F.when(F.contains(payload, F.lit("\\u")), flagged).otherwise(payload)


def storage_text_ok(raw_json: Column) -> Column:
    """No NUL and no lone surrogate in any text or property name of a raw JSON document."""
    return ~F.contains(_flagged(raw_json), F.lit(UNSTORABLE))


def parsed_pages(pages: DataFrame) -> DataFrame:
    """Payload text as a variant: fields keep their types and unknown fields are kept."""
    return computed_once(pages, "page", F.try_parse_json(_flagged(F.col("payload"))))


def _kind_of(schema: Column) -> Column:
    """JSON type named by the schema of a variant."""
    return (
        F.when(schema == "VOID", "null")
        .when(schema.startswith("OBJECT"), "object")
        .when(schema.startswith("ARRAY"), "array")
        .when(schema == "STRING", "string")
        .when(schema == "BOOLEAN", "boolean")
        .when(schema.isNotNull(), "number")
    )


def _kind(value: Column) -> Column:
    """JSON type of a variant: object, array, string, boolean, number, null, or SQL null when absent."""
    return _kind_of(F.schema_of_variant(value))


def envelope_check(pages: DataFrame) -> DataFrame:
    """Pages refused as a whole, with the reason: the root must be an object with a result array."""
    root = _kind(F.col("page"))
    results = _kind(F.try_variant_get("page", "$.resultats", "variant"))
    filters = _kind(F.try_variant_get("page", "$.filtresPossibles", "variant"))
    issue = (
        F.when(F.col("page").isNull(), "invalid_json")
        .when(root != "object", "root_not_object")
        .when(F.coalesce(results, F.lit("absent")) != "array", "result_list_missing")
        .when(F.coalesce(filters, F.lit("array")) != "array", "filters_not_array")
    )
    return pages.withColumn("root_issue", issue)


def read_offer_pages(pages: DataFrame) -> DataFrame:
    """One row per raw offer with its place in the page, from the pages whose envelope holds."""
    checked = envelope_check(pages).filter(F.col("root_issue").isNull())
    items = F.posexplode(F.variant_get("page", "$.resultats", "array<variant>")).alias("item_ordinal", "raw")
    return checked.select("query_key", "range_start", items)


ENVELOPE = ("root_issue", "root_warnings")


def envelopes(pages: DataFrame) -> DataFrame:
    """Pages with what `page_status` needs of them: why they are refused, and how many unknown fields their root has."""
    root = F.coalesce(F.json_object_keys("payload"), F.array().cast("array<string>"))
    extra = F.size(F.array_except(root, F.array(*[F.lit(f) for f in ROOT_FIELDS])))
    return envelope_check(pages).withColumn("root_warnings", extra)


def read_enveloped_pages(pages: DataFrame) -> DataFrame:
    """The rows of `read_offer_pages` with the envelope of their page. A page without a row has one without ordinal."""
    results = F.when(F.col("root_issue").isNull(), F.variant_get("page", "$.resultats", "array<variant>"))
    return envelopes(pages).select("query_key", "range_start", *ENVELOPE, F.posexplode_outer(results).alias("item_ordinal", "raw"))


# ---------------------------------------------------------------- contract of one item


_FIELDS = "map<string,variant>"


def _specs() -> Column:
    """The contract as one map literal: path -> (position, kind, low, high)."""
    kinds = {**OFFER_FIELDS, **{f"{f}.{n}": k for f, nested in NESTED_FIELDS.items() for n, k in nested.items()}}
    entries = []
    for position, (path, kind) in enumerate(kinds.items()):
        low, high = kind if isinstance(kind, tuple) else (0.0, None)
        name = "range" if isinstance(kind, tuple) else kind
        spec = F.struct(
            F.lit(position).alias("position"), F.lit(name).alias("kind"),
            F.lit(low).cast("double").alias("low"), F.lit(high).cast("double").alias("high"),
        )
        entries += [F.lit(path), spec]
    return F.create_map(*entries)


def _all_fields(raw: Column) -> Column:
    """Fields of an offer and of its known nested objects as (path, value, schema), read once."""
    root = F.try_variant_get(raw, "$", _FIELDS)
    entry = lambda path, e: F.struct(path.alias("path"), e["value"].alias("value"), F.schema_of_variant(e["value"]).alias("schema"))
    parts = [F.transform(F.map_entries(root), lambda e: entry(e["key"], e))]
    for field in NESTED_FIELDS:
        nested = F.map_entries(F.try_variant_get(raw, f"$.{field}", _FIELDS))
        prefix = F.lit(f"{field}.")
        parts.append(_prefixed(nested, prefix, entry))
    none = F.array().cast("array<struct<path:string,value:variant,schema:string>>")
    return F.concat(*[F.coalesce(p, none) for p in parts])


def _prefixed(entries: Column, prefix: Column, entry) -> Column:
    return F.transform(entries, lambda e: entry(F.concat(prefix, e["key"]), e))


def _wrong_items(value: Column) -> Column:
    """An array item of languages or licences that is not an object of texts."""

    def wrong(item: Column) -> Column:
        texts = F.try_variant_get(item, "$", _FIELDS)
        odd = F.map_filter(texts, lambda name, v: name.isin("libelle", "exigence") & (F.schema_of_variant(v) != "STRING"))
        return F.coalesce(F.size(odd) > 0, F.lit(True))

    return F.coalesce(F.exists(F.try_variant_get(value, "$", "array<variant>"), wrong), F.lit(False))


def _field_issue(field: Column) -> Column:
    """(position, path, code) of a field of the contract that is present but wrong, else null."""
    spec, kind, value = field["spec"], field["kind"], field["value"]
    number = F.try_variant_get(value, "$", "double")
    wanted = F.when(spec["kind"].isin("range", "count"), "number").otherwise(spec["kind"])
    listed = F.exists(F.try_variant_get(value, "$", "array<variant>"), lambda i: F.schema_of_variant(i) != "STRING")
    texts = (kind == "string") | ((kind == "array") & ~F.coalesce(listed, F.lit(True)))
    outside = ~number.between(spec["low"], F.coalesce(spec["high"], number)) | (
        (spec["kind"] == "count") & (number != F.floor(number))
    )
    code = (
        F.when(spec["kind"] == "string_or_strings", F.when(~texts, "invalid_type"))
        .when(kind != wanted, "invalid_type")
        .when(spec["kind"].isin("range", "count") & outside, "out_of_range")
        .when(field["path"].isin(*MANDATORY) & (F.try_variant_get(value, "$", "string") == ""), "too_small")
        .when(field["path"].isin(*ITEM_FIELDS) & (kind == "array") & _wrong_items(value), "invalid_type")
    )
    return F.when(code.isNotNull(), F.struct(spec["position"].alias("position"), field["path"].alias("path"), code.alias("code")))


def contract_issues(raw: Column) -> Column:
    """Issues of one offer as an array of (path, code) in the order of the contract; empty when it is valid.

    All fields are walked by one small lambda against a map of the contract, so the expression does not
    grow with the number of fields.
    """
    specs = _specs()
    fields = F.transform(
        _all_fields(raw),
        lambda f: F.struct(
            f["path"].alias("path"), f["value"].alias("value"), _kind_of(f["schema"]).alias("kind"),
            F.try_element_at(specs, f["path"]).alias("spec"),
        ),
    )
    known = F.filter(fields, lambda f: f["spec"].isNotNull())
    wrong = F.array_compact(F.transform(known, _field_issue))
    root = F.map_keys(F.try_variant_get(raw, "$", _FIELDS))
    absent = F.array_compact(
        F.array(
            *[
                F.when(
                    ~F.array_contains(root, name),
                    F.struct(F.lit(list(OFFER_FIELDS).index(name)).alias("position"), F.lit(name).alias("path"), F.lit("invalid_type").alias("code")),
                )
                for name in MANDATORY
            ]
        )
    )
    ordered = F.transform(F.array_sort(F.concat(wrong, absent)), lambda i: F.struct(i["path"], i["code"]))
    not_object = F.array(F.struct(F.lit("").alias("path"), F.lit("invalid_type").alias("code")))
    return F.when(root.isNull(), not_object).otherwise(ordered)


def validate_contract(items: DataFrame) -> DataFrame:
    """Items with their issues; valid ones have none. One bad item never drops its neighbours."""
    issues = contract_issues(F.col("raw"))
    storage = F.when(F.contains(F.to_json("raw"), F.lit(UNSTORABLE)), F.array(F.struct(F.lit("").alias("path"), F.lit("storage_text").alias("code"))))
    none = F.array().cast("array<struct<path:string,code:string>>")
    return computed_once(items, "issues", F.concat(issues, F.coalesce(storage, none)))


def valid_items(checked: DataFrame) -> DataFrame:
    return checked.filter(F.size("issues") == 0)


def quarantined_items(checked: DataFrame) -> DataFrame:
    return checked.filter(F.size("issues") > 0)


def unknown_field_report(checked: DataFrame) -> DataFrame:
    """Fields of valid offers outside the contract, with the observed JSON type; the offer stays valid."""
    fields = F.try_variant_get("raw", "$", "map<string,variant>")
    unknown = F.map_filter(fields, lambda name, _: ~name.isin(*OFFER_FIELDS))
    rows = valid_items(checked).select("query_key", "range_start", "item_ordinal", F.explode(unknown).alias("field", "value"))
    return rows.select(
        "query_key",
        "range_start",
        F.concat(F.lit("resultats."), F.col("item_ordinal").cast("string")).alias("path"),
        F.when(F.contains("field", F.lit(UNSTORABLE)), MASKED_FIELD).otherwise(F.col("field")).alias("field"),
        _kind(F.col("value")).alias("observed_type"),
    )


def unknown_root_fields(pages: DataFrame) -> DataFrame:
    """Fields beside the result list of pages whose envelope holds, in the columns of `unknown_field_report`."""
    fields = F.try_variant_get("page", "$", "map<string,variant>")
    unknown = F.map_filter(fields, lambda name, _: ~name.isin(*ROOT_FIELDS))
    rows = envelope_check(pages).filter(F.col("root_issue").isNull()).select("query_key", "range_start", F.explode(unknown).alias("field", "value"))
    return rows.select(
        "query_key",
        "range_start",
        F.lit("$root").alias("path"),
        F.when(F.contains("field", F.lit(UNSTORABLE)), MASKED_FIELD).otherwise(F.col("field")).alias("field"),
        _kind(F.col("value")).alias("observed_type"),
    )


def page_status(pages: DataFrame, checked: DataFrame, unknown: DataFrame) -> DataFrame:
    """Per page: valid, valid_with_warnings or invalid_quarantined. Pages with their envelope are not parsed again."""
    keys = ["query_key", "range_start"]
    items = checked.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("received"), F.count_if(F.size("issues") > 0).alias("quarantined")
    )
    warned = unknown.groupBy(*keys).agg(F.count(F.lit(1)).alias("warnings"))
    known = pages if set(ENVELOPE) <= set(pages.columns) else envelopes(pages)
    joined = known.join(items, keys, "left").join(warned, keys, "left")
    zero = lambda c: F.coalesce(c, F.lit(0))
    status = (
        F.when(F.col("root_issue").isNotNull(), "invalid_quarantined")
        .when((zero("quarantined") > 0) | (zero("warnings") > 0) | (F.col("root_warnings") > 0), "valid_with_warnings")
        .otherwise("valid")
    )
    return joined.select(
        *keys, "root_issue", zero("received").alias("received"), zero("quarantined").alias("quarantined"),
        (zero("warnings") + F.when(F.col("root_issue").isNull(), F.col("root_warnings")).otherwise(0)).alias("warnings"),
        status.alias("status"),
    )
