"""Fixed values of the PII vocabulary: types, hints, patterns, strategies, markers and date formats.

They have to equal the published ones for detections and masks to agree, so they are stated as they are.
"""

# Quasi-identifiers; every other type identifies a person directly.
INDIRECT_TYPES = [
    "age", "gender", "salary", "occupation", "marital_status", "education", "nationality", "employee_id",
    "device_id", "vehicle_vin", "zip_code",
]

STRATEGIES = {
    "email": "synthetic", "ssn": "hash", "phone": "synthetic", "credit_card": "hash", "ip": "synthetic",
    "name": "synthetic", "address": "synthetic", "date_of_birth": "synthetic", "passport": "hash",
    "drivers_license": "hash", "bank_account": "hash", "medical_record": "hash", "national_id": "hash",
    "tax_id": "hash", "username": "synthetic", "password": "redact", "biometric": "redact",
    "license_plate": "hash", "geolocation": "generalize", "ethnicity": "redact", "religion": "redact",
    "political_opinion": "redact",
    "age": "generalize", "gender": "generalize", "salary": "generalize", "occupation": "generalize",
    "marital_status": "generalize", "education": "generalize", "nationality": "generalize",
    "employee_id": "hash", "device_id": "hash", "vehicle_vin": "hash", "zip_code": "generalize",
}

# Tried in this order on a column's values; the highest match rate above one half wins.
PATTERNS = {
    "email": r"^[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}$",
    "ssn": r"^\d{3}-?\d{2}-?\d{4}$",
    "phone": r"^[\+]?[(]?\d{1,4}[)]?[-\s.]?\d{1,4}[-\s.]?\d{1,9}$",
    "credit_card": r"^\d{4}[-\s]?\d{4}[-\s]?\d{4}[-\s]?\d{4}$",
    "ip": r"^\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}$",
}

# The first type, in this order, with a hint inside the column name wins.
NAME_HINTS = {
    "name": ["name", "first_name", "last_name", "full_name", "firstname", "lastname", "fname", "lname",
             "customer_name", "user_name", "username", "patient_name"],
    "email": ["email", "e_mail", "email_address", "mail", "user_email"],
    "phone": ["phone", "telephone", "tel", "mobile", "cell", "phone_number", "contact_number", "phone_no"],
    "ssn": ["ssn", "social_security", "social_security_number", "sin"],
    "address": ["address", "street", "street_address", "addr", "home_address", "mailing_address"],
    "credit_card": ["credit_card", "card_number", "cc_number", "card_no", "ccn"],
    "ip": ["ip", "ip_address", "ipaddress", "source_ip", "dest_ip", "client_ip"],
    "date_of_birth": ["dob", "date_of_birth", "birth_date", "birthday", "birthdate"],
    "age": ["age", "customer_age", "patient_age", "user_age"],
    "gender": ["gender", "sex", "biological_sex"],
    "salary": ["salary", "income", "compensation", "annual_salary", "wage", "pay", "earnings", "annual_income"],
    "occupation": ["occupation", "job_title", "job", "position", "role", "title", "profession", "designation"],
    "marital_status": ["marital_status", "marital", "marriage_status", "relationship_status"],
    "education": ["education", "degree", "education_level", "qualification", "highest_education", "school"],
    "nationality": ["nationality", "country_of_origin", "citizenship", "country_of_birth"],
    "employee_id": ["employee_id", "emp_id", "staff_id", "worker_id", "personnel_id", "student_id", "member_id",
                    "badge_id"],
    "device_id": ["device_id", "mac_address", "imei", "serial_number", "hardware_id", "uuid", "device_uuid"],
    "vehicle_vin": ["vin", "vehicle_vin", "vehicle_identification", "chassis_number"],
    "zip_code": ["zip", "zipcode", "zip_code", "postal_code", "postcode", "pin_code"],
}

MARKERS = {
    "email": "***@***.***", "ssn": "***-**-****", "phone": "***-***-****", "credit_card": "****-****-****-****",
    "ip": "***.***.***.***", "address": "[REDACTED ADDRESS]", "date_of_birth": "****-**-**",
}
DEFAULT_MARKER = "[REDACTED]"
GENERALIZED = "[GENERALIZED]"

# (Spark datetime pattern, shape of the text or None where the shape alone cannot tell).
DATE_FORMATS = [
    ("yyyy-MM-dd", r"^\d{4}-\d{2}-\d{2}$"),
    ("M/d/yyyy", r"^\d{1,2}/\d{1,2}/\d{4}$"),
    ("d/M/yyyy", None),
    ("M-d-yyyy", r"^\d{1,2}-\d{1,2}-\d{4}$"),
    ("d-MMM-yyyy", r"^\d{1,2}-[A-Za-z]{3}-\d{4}$"),
    ("MMMM d, yyyy", r"^[A-Za-z]+ \d{1,2}, \d{4}$"),
    ("MMM d, yyyy", r"^[A-Za-z]{3} \d{1,2}, \d{4}$"),
    ("d MMMM yyyy", r"^\d{1,2} [A-Za-z]+ \d{4}$"),
    ("yyyy/MM/dd", r"^\d{4}/\d{2}/\d{2}$"),
    ("d.M.yyyy", r"^\d{1,2}\.\d{1,2}\.\d{4}$"),
    ("M.d.yyyy", None),
    ("yyyyMMdd", r"^\d{8}$"),
]
