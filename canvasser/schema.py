"""Entity schemas and the fixed value lists of the data model."""

from __future__ import annotations

from pyspark.sql import types as T

# Times are UTC without a zone, as the stored tables have them.
S, L, I, B, TS = T.StringType(), T.LongType(), T.IntegerType(), T.BooleanType(), T.TimestampNTZType()


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(n, t, True) for n, t in fields.items()])


SCHOOL_ROW = _struct(
    facility_key=S, name=S, district_id=I, phone_number=S, address=S, class_size=I,
    rating=T.DoubleType(), type_of_school=S, admin=S, city=S, zipcode=S, grades_served=S,
    website=S, county_name=S, is_active=B, notes=S, created_at=TS, updated_at=TS,
    enrollment=I, grade_range=S, data_source=S, is_verified=B, last_verified_at=TS,
    priority_tier=S,
)
STAFF_ROW = _struct(
    staff_id=L, name=S, phone=S, email=S, job_name=S, school_worked_at=S, is_active=B,
    notes=S, created_at=TS, updated_at=TS, data_source=S, is_verified=B, last_verified_at=TS,
)
JUNCTION_ROW = _struct(school_id=S, staff_id=L, seq=L)
EVENT_ROW = _struct(
    event_id=L, schools_involved=S, location=S, time=S, date=TS, attendance=L, is_scraped=B,
    external_id=S, fair_name=S, created_at=TS, updated_at=TS,
)
PROGRAM_ROW = _struct(
    program_id=S, school_id=S, name=S, category=S, description=S, is_active=B,
    created_at=TS, updated_at=TS,
)
ACTIVITY_ROW = _struct(
    activity_id=S, school_id=S, contact_id=S, event_id=S, activity_type=S, date=TS,
    description=S, outcome=S,
)
CONTACT_BLOB = _struct(name=S, title=S, dept=S, phone=S, email=S)
RESULT_BLOB = _struct(
    school_urls=_struct(base_url=S, alt_url=S, pages_with_contacts=T.ArrayType(S)),
    contacts=T.ArrayType(CONTACT_BLOB),
    error=S,
)
# Objects whose field names vary: nested values stay JSON text.
LOOSE_OBJECT = T.MapType(S, S)
CALENDAR_RECORD = _struct(
    id=S, field_2=S, field_3=S,
    field_1_raw=_struct(date=S, time_formatted=S, to=_struct(time_formatted=S)),
    field_38=S,
)

# Fixed values of the data model.
STATE = "IL"
UNKNOWN_EVENT = "Untitled Event"
PROGRAM_LABELS = {
    "cs": "Computer Science",
    "engineering": "Engineering",
    "robotics": "Robotics",
    "stem_club": "STEM Club",
    "math_club": "Math Club",
    "science_club": "Science Club",
    "other": "Other",
}
PROGRAM_CATEGORIES = list(PROGRAM_LABELS)
ROLE_LABELS = {
    "superintendent": "Superintendent",
    "principal": "Principal",
    "counselor": "Counselor",
    "cs_teacher": "CS Teacher",
    "engineering_teacher": "Engineering Teacher",
    "math_teacher": "Math Teacher",
    "science_teacher": "Science Teacher",
}
EVENT_LABELS = {
    "outreach_fair": "Outreach Fair",
    "campus_visit": "Campus Visit",
    "recruitment_event": "Recruitment Event",
    "summer_camp": "Summer Camp",
    "workshop": "Workshop",
    "other": "Other",
}
# Role text to role, looked up in lower case.
ROLE_SYNONYMS = {
    "superintendent": "superintendent",
    "principal": "principal",
    "counselor": "counselor",
    "cs_teacher": "cs_teacher",
    "engineering_teacher": "engineering_teacher",
    "math_teacher": "math_teacher",
    "science_teacher": "science_teacher",
    "cs teacher": "cs_teacher",
    "computer science teacher": "cs_teacher",
    "computer science": "cs_teacher",
    "computing teacher": "cs_teacher",
    "engineering teacher": "engineering_teacher",
    "engineering": "engineering_teacher",
    "math teacher": "math_teacher",
    "mathematics teacher": "math_teacher",
    "mathematics": "math_teacher",
    "math": "math_teacher",
    "science teacher": "science_teacher",
    "science": "science_teacher",
    "guidance counselor": "counselor",
    "school counselor": "counselor",
    "guidance": "counselor",
    "district superintendent": "superintendent",
    "supt": "superintendent",
}
# Title words to role, in order of preference.
ROLE_TITLE_WORDS = [
    (["superintendent"], "superintendent"),
    (["principal"], "principal"),
    (["counselor", "guidance"], "counselor"),
    (["computer science", "computing"], "cs_teacher"),
    (["engineering"], "engineering_teacher"),
    (["math"], "math_teacher"),
    (["science"], "science_teacher"),
]
# Import header text to field. "name" depends on the entity.
HEADER_SYNONYMS = {
    "first name": "firstName",
    "firstname": "firstName",
    "first_name": "firstName",
    "last name": "lastName",
    "lastname": "lastName",
    "last_name": "lastName",
    "email": "email",
    "email address": "email",
    "phone": "phone",
    "phone number": "phone",
    "role": "role",
    "title": "role",
    "school": "schoolId",
    "school name": "name",
    "district": "district",
    "county": "county",
    "address": "address",
    "city": "city",
    "state": "state",
    "zip": "zipCode",
    "zipcode": "zipCode",
    "zip code": "zipCode",
    "type": "schoolType",
    "school type": "schoolType",
    "notes": "notes",
}
# Fixed texts of the report: headings by section, and the labels of the summary columns.
REPORT_HEADINGS = {
    1: ["", "=== SUMMARY ==="],
    2: ["", "=== TOP ENGAGED SCHOOLS ===", "School,Score,Activities,Active Contacts,Events Appeared"],
    3: ["", "=== SCHOOLS NEEDING ATTENTION ===", "School,County,Contacts,Last Activity,Priority,Issues"],
}
REPORT_METRICS = [
    ("Total Schools", "total_schools"),
    ("Active Contacts", "active_contacts"),
    ("Total Events", "total_events"),
    ("Schools Engaged (with activity)", "engaged_schools"),
    ("Total Event Attendees", "total_attendees"),
]
# Fixed values of the page extraction.
EMAIL_PATTERN = r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}@[A-Za-z0-9.-]{1,253}\.[A-Za-z]{2,24}\b"
MESSAGE_PATTERN = r"send\s*email|send\s*message|email|message"
PHONE_PATTERN = r"(?:\+?1[\s.-]?)?\(?\d{3}\)?[\s.-]?\d{3}[\s.-]?\d{4}(?:\s*(?:x|ext\.?)\s*\d+)?"
ENROLLMENT_PATTERN = r"enrollment:\s*([\d,]+)"
TITLE_TERMS = [
    "principal", "counselor", "college counselor", "career counselor", "dean",
    "dean of students", "student services", "student affairs", "admissions",
]
TITLE_REJECTS = [
    "elementary", "grade school", "middle school", "junior high", "intermediate", "primary",
    "pre-k", "es", "bes", "sub", "substitute", "assistant",
]
CONTACT_PATHS = [
    "/staff", "/directory", "/staff-directory", "/staffdirectory", "/faculty", "/about/staff",
    "/administration", "/staff-directory-page", "/contact-us", "/staff-contacts",
    "/administrators", "/apps/staff", "/vnews/display.v/StaffDirectory", "/faculty-and-staff",
    "/faculty_staff",
]
BLOCK_TAGS = ["li", "tr", "div", "section", "article", "td"]
# Fixed values of the name plausibility check.
ORGANISATION_WORDS = [
    "school", "district", "building", "department", "campus", "office", "academy",
    "elementary", "middle", "high", "board",
]
# No number, written as text.
NULL_WORDS = ["none", "null", "(pending)", "pending"]
# Short school-type words that stand for a longer one in link texts.
SCHOOL_ABBREVIATIONS = ["sr", "jr", "jr/sr", "sch", "chd", "int", "s", "hs"]
DIRECTORY_SLOTS = ["administrator", "second", "third", "fourth", "fifth", "sixth", "seventh"]
