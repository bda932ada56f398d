"""Declared fields per document type and the metrics that score them.

The catalog is a fixed table of a few dozen rows, so it is the one table in
this package that is broadcast unconditionally.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .constants import DEFAULT_METRIC

# Document type -> declared fields as (name, declared type, metrics).
# A field without metrics falls back to the default metric.
FIELDS: dict[str, list[tuple[str, str, tuple[str, ...]]]] = {
    "cni": [
        ("numero_document", "string", ("compare_number",)),
        ("date_delivrance", "date", ("string_date_equality",)),
        ("date_expiration", "date", ("string_date_equality",)),
        ("nom", "string", ("levenshtein_distance",)),
        ("prenom", "string", ("levenshtein_distance",)),
        ("date_naissance", "date", ("string_date_equality",)),
        ("lieu_naissance", "string", ("levenshtein_distance",)),
        ("nationalite", "string", ("levenshtein_distance",)),
        ("bande_mrz", "string", ("levenshtein_distance",)),
    ],
    "passeport": [
        ("numero_document", "string", ("compare_number",)),
        ("nom", "string", ("levenshtein_distance",)),
        ("prenom", "string", ("levenshtein_distance",)),
        ("lieu_naissance", "string", ("levenshtein_distance",)),
        ("nationalite", "string", ("levenshtein_distance",)),
        ("bande_mrz", "string", ("levenshtein_distance",)),
        ("date_delivrance", "date", ("string_date_equality",)),
        ("date_expiration", "date", ("string_date_equality",)),
        ("date_naissance", "date", ("string_date_equality",)),
    ],
    "permis_conduire": [
        ("numero_document", "string", ("compare_number",)),
        ("date_delivrance", "date", ("string_date_equality",)),
        ("date_expiration", "date", ("string_date_equality",)),
        ("nom", "string", ("levenshtein_distance",)),
        ("prenom", "string", ("levenshtein_distance",)),
        ("date_naissance", "date", ("string_date_equality",)),
        ("lieu_naissance", "string", ("levenshtein_distance",)),
        ("adresse", "string", ("levenshtein_distance",)),
    ],
    "avis_imposition": [
        ("annee_revenus", "string", ("compare_number",)),
        ("date_mise_en_recouvrement", "date", ("string_date_equality",)),
        ("declarant_1_identite", "string", ("skip",)),
        ("declarant_1_nom_naissance", "string", ("skip",)),
        ("declarant_1_numero_fiscal", "string", ("compare_number",)),
        ("declarant_2_identite", "string", ("skip",)),
        ("declarant_2_nom_naissance", "string", ("skip",)),
        ("declarant_2_numero_fiscal", "string", ("compare_number",)),
        ("reference_avis", "string", ("compare_number",)),
        ("nombre_parts", "double", ("compare_number",)),
        ("revenu_fiscal_reference", "double", ("compare_number",)),
        ("revenu_brut_global", "double", ("compare_number",)),
        ("revenu_imposable", "double", ("compare_number",)),
        ("impot_revenu_net_avant_corrections", "double", ("compare_number",)),
        ("montant_impot", "double", ("skip",)),
    ],
    "bulletin_salaire": [
        ("nom_employeur", "string", ("levenshtein_distance",)),
        ("siret", "string", ("compare_number",)),
        ("identite_salarie", "string", ("token_set_equality", "levenshtein_distance")),
        ("adresse_salarie", "string", ("levenshtein_distance",)),
        ("periode_debut", "date", ("string_date_equality",)),
        ("periode_fin", "date", ("string_date_equality",)),
        ("date_paiement", "date", ("string_date_equality",)),
        ("date_debut_contrat", "date", ("string_date_equality",)),
        ("net_imposable", "double", ("compare_number",)),
        ("cumul_net_imposable", "double", ("compare_number",)),
    ],
    "visale_certificate": [
        ("numero_visa", "string", ("levenshtein_distance",)),
        ("date_delivrance", "date", ("string_date_equality",)),
        ("date_fin_validite", "date", ("string_date_equality",)),
        ("beneficiaires", "array<struct<nom:string,prenoms:string>>", ()),
    ],
}

CATALOG_SCHEMA = (
    "document_type string, field string, declared_type string, metrics array<string>"
)


def field_catalog(spark: SparkSession) -> DataFrame:
    """One row per declared field: (document_type, field, declared_type, metrics)."""
    rows = [
        (doc_type, name, declared, list(metrics) or [DEFAULT_METRIC])
        for doc_type, fields in FIELDS.items()
        for name, declared, metrics in fields
    ]
    return spark.createDataFrame(rows, CATALOG_SCHEMA)


CHECKS_SCHEMA = "document_type string, checks array<struct<field:string,pos:int,metric:string>>"


def default_checks(spark: SparkSession) -> DataFrame:
    """The fixed catalog, one row per document type with its (field, metric) checks."""
    rows = [
        (
            doc_type,
            [
                (name, pos, metric)
                for name, _, metrics in fields
                for pos, metric in enumerate(metrics or (DEFAULT_METRIC,))
            ],
        )
        for doc_type, fields in FIELDS.items()
    ]
    return spark.createDataFrame(rows, CHECKS_SCHEMA)


def checks_by_type(catalog: DataFrame) -> DataFrame:
    """A catalog table folded to one row per document type with an array of checks."""
    return (
        catalog.select(
            "document_type", "field", F.posexplode("metrics").alias("pos", "metric")
        )
        .groupBy("document_type")
        .agg(F.sort_array(F.collect_list(F.struct("field", "pos", "metric"))).alias("checks"))
    )


def properties_ddl(document_type: str) -> str:
    """DDL of the typed properties of one document type, for ``from_json``."""
    return ", ".join(f"{name} {declared}" for name, declared, _ in FIELDS[document_type])
