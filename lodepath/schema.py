"""The declared schema: nested input documents, the flat table of 33 columns, and what may be asked of it."""

from __future__ import annotations

from pyspark.sql import types as T

# --- fixed values: names and kinds of the input document's fields, in the order of their blobs ---
#: kinds: s text, n number, i whole number, b true or false, l list of texts, d date-time; a capital is required.
JOB_INFORMATION = "title:S job_title_raw:S description:S viewedByUsers:l savedFromUsers:l hiddenFromUsers:l appliedFromUsers:l"
PROCESSED = """
core_job_title:s requirements_summary:s technical_tools:l licenses_or_certifications:l licenses_or_certifications_not_mentioned:b
associates_degree_requirement:s associates_degree_fields_of_study:l bachelors_degree_requirement:s bachelors_degree_fields_of_study:l
masters_degree_requirement:s masters_degree_fields_of_study:l doctorate_degree_requirement:s doctorate_degree_fields_of_study:l is_high_school_required:b
min_industry_and_role_yoe:n is_min_industry_and_role_yoe_not_mentioned:b min_management_and_leadership_yoe:n is_min_management_and_leadership_yoe_not_mentioned:b
job_category:s role_activities:l commitment:l role_type:s seniority_level:s security_clearance:s position_employer_type:s
workplace_type:s workplace_physical_environment:s formatted_workplace_location:s workplace_cities:l workplace_counties:l workplace_states:l workplace_countries:l workplace_continents:l
boundless_workplace_states:l boundless_workplace_countries:l boundless_workplace_continents:l
number_of_workplace_cities:i number_of_workplace_counties:i number_of_workplace_states:i number_of_workplace_countries:i number_of_workplace_continents:i is_workplace_worldwide_ok:b
oral_communication_level:s physical_labor_intensity:s physical_position:s computer_usage:s cognitive_demand:s air_travel_requirement:s land_travel_requirement:s
morning_shift_work:s evening_shift_work:s overnight_work:s on_call_requirement:s
weekend_availability_required:b holiday_availability_required:b overtime_required:b is_driver_license_required:b
generous_paid_time_off:b four_day_work_week:b fair_chance:b visa_sponsorship:b relocation_assistance:b military_veterans:b tuition_reimbursement:b retirement_plan:b generous_parental_leave:b 401k_matching:b
yearly_min_compensation:n yearly_max_compensation:n monthly_min_compensation:n monthly_max_compensation:n weekly_min_compensation:n weekly_max_compensation:n
bi-weekly_min_compensation:n bi-weekly_max_compensation:n daily_min_compensation:n daily_max_compensation:n hourly_min_compensation:n hourly_max_compensation:n
is_compensation_transparent:b listed_compensation_currency:s listed_compensation_frequency:s
language_requirements:l num_language_requirements:i estimated_publish_date:d estimated_publish_date_millis:i
company_name:s company_website:s company_sector_and_industry:s company_activities:l company_tagline:s
"""
ENRICHED = """
enriched_at:d status:s name:s homepage_uri:s hq_country:s parent_company:s subsidiaries:l industries:l activities:l nb_employees:i year_founded:i tagline:s organization_type:s
latest_funding_investors:l latest_funding_type:s latest_funding_year:i latest_funding_amount:n stock_exchange:s stock_symbol:s
"""
#: u: text or whole number.
JOB = "id:S board_token:U source:S apply_url:S source_and_board_token:S original_source_id:u requisition_id:S collapse_key:S is_expired:B objectID:S"
#: Columns of the flat table, in order: name, type, and ! where never null.
TABLE = """
id string!, source string!, board_token string!, apply_url string!, requisition_id string!, collapse_key string!, is_expired boolean!, title string!, job_title_raw string!, description string!,
core_job_title string, job_category string, seniority_level string, role_type string, workplace_type string, formatted_workplace_location string, workplace_countries string!,
min_industry_and_role_yoe double, yearly_min_compensation double, yearly_max_compensation double, listed_compensation_currency string, technical_tools string!, estimated_publish_date string,
company_name string, company_website string, enriched_status string, nb_employees bigint, year_founded bigint, latitude double, longitude double,
job_information_json string!, v5_processed_job_data_json string!, enriched_company_data_json string
"""
# --- fixed values: columns that results show, in their order ---
FILL_COLUMNS = (
    "core_job_title job_category seniority_level role_type workplace_type formatted_workplace_location workplace_countries min_industry_and_role_yoe yearly_min_compensation "
    "yearly_max_compensation listed_compensation_currency technical_tools estimated_publish_date company_name company_website enriched_status nb_employees year_founded latitude longitude"
).split()
PAGE_COLUMNS = "requisition_id title company_name formatted_workplace_location workplace_type yearly_min_compensation yearly_max_compensation listed_compensation_currency estimated_publish_date".split()
SEARCH_COLUMNS = ["title", "company_name", "formatted_workplace_location"]
# --- end of fixed values ---
KEY = "requisition_id"


def fields(spec: str) -> list[tuple[str, str]]:
    return [tuple(x.split(":")) for x in spec.split()]


def _table() -> T.StructType:
    kinds = {"string": T.StringType(), "boolean": T.BooleanType(), "double": T.DoubleType(), "bigint": T.LongType()}
    out = []
    for part in TABLE.replace("\n", " ").split(","):
        name, kind = part.split()
        out.append(T.StructField(name, kinds[kind.rstrip("!")], not kind.endswith("!")))
    return T.StructType(out)


#: The flat table. Whole numbers are long everywhere, so no value that the input allows is out of range.
JOBS = _table()
NAMES = frozenset(JOBS.names)


def check_column(name: str) -> str:
    """A column of the flat table, or ValueError: names never reach a plan unchecked."""
    if name not in NAMES:
        raise ValueError(f"Unknown column {name!r}; not in the jobs table.")
    return name
