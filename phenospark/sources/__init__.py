"""Sources and sinks: potential-cases tables out of CSV, FHIR, OMOP, i2b2 and
XML exports; codelist and steplist files; cases out; named connectors."""

from phenospark.sources.ndjson import cases_from_events, record_tables, scan_resources
from phenospark.sources.tabular import drop_old_versions, publish_dataset, read_cohort_csv, read_dataset, write_cases
from phenospark.sources.records import cohort_from_fhir, cohort_from_i2b2, cohort_from_omop, cohort_from_xml
from phenospark.sources.files import codelists_from_concept_export, read_codelists, read_steplist
from phenospark.sources.registry import read_source, register_source

__all__ = [
    "read_cohort_csv", "write_cases", "publish_dataset", "cohort_from_fhir", "cohort_from_omop",
    "cohort_from_i2b2", "cohort_from_xml", "read_codelists", "read_steplist", "codelists_from_concept_export",
    "register_source", "read_source", "read_dataset", "drop_old_versions", "scan_resources", "record_tables", "cases_from_events",
]
