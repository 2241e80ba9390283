"""The fields of a form: order, labels, aliases and the length of their values in words."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

# Key, serial, label, printed on the form, least / most / usual number of words, kind of value.
FIELDS = [
    ("form_no", "1", "Form No", False, None, None, None, None),
    ("record_no", "2", "Record No", True, 1, 1, 1, "record"),
    ("invoice_no", "3", "Invoice No", True, 1, 2, 1, "invoice"),
    ("date_of_purchase", "4", "Date of Purchase", True, 1, 1, 1, "date"),
    ("customer_id", "5", "Customer Id", True, 1, 1, 1, "customer"),
    ("file_no", "6", "File No", True, 1, 1, 1, "file"),
    ("ph_name", "7", "Policy Holder Name", True, 1, 4, 2, "name"),
    ("ph_address", "8", "Policy Holder Address", True, 1, 7, 3, "address"),
    ("ph_city", "9", "Policy Holder City", True, 1, 3, 2, "city"),
    ("ph_state", "10", "Policy Holder State", True, 1, 1, 1, "state"),
    ("ph_zip", "11", "Policy Holder Zip", True, 1, 2, 1, "zip"),
    ("ph_phone", "12", "Policy Holder Phone", True, 1, 2, 2, "phone"),
    ("ph_email", "13", "PH Email", True, 1, 1, 1, "email"),
    ("ph_dob", "14", "PH DOB", True, 1, 1, 1, "date"),
    ("education", "15", "Education", True, 1, 1, 1, "na"),
    ("nominee_name", "16", "Nominee Name", True, 1, 4, 2, "name"),
    ("nominee_address", "17", "Nominee Address", True, 1, 7, 3, "address"),
    ("nominee_city", "18", "Nominee City", True, 1, 3, 2, "city"),
    ("nominee_state", "19", "Nominee State", True, 1, 1, 1, "state"),
    ("nominee_zip", "20", "Nominee Zip", True, 1, 2, 1, "zip"),
    ("relation_with_nominee", "21", "Relation With Nominee", True, 1, 1, 1, "na"),
    ("chest", "22", "Chest", True, 1, 1, 1, "int:60:99"),
    ("height", "23", "Height", True, 1, 1, 1, "int:140:210"),
    ("weight", "24", "Weight", True, 1, 1, 1, "int:80:220"),
    ("blood_group", "25", "Blood Group", True, 1, 2, 1, "blood"),
    ("policy_no", "26", "Policy No", True, 1, 2, 1, "policy"),
    ("reference_no", "27", "Reference No", True, 1, 1, 1, "code16"),
    ("agent_name", "28", "Agent Name", True, 1, 12, 3, "agent_name"),
    ("agent_address", "29", "Agent Address", True, 1, 8, 3, "address"),
    ("agent_city", "30", "Agent City", True, 1, 3, 1, "city"),
    ("agent_state", "31", "Agent State", True, 1, 2, 1, "state"),
    ("agent_zip", "32", "Agent Zip Code", True, 1, 1, 1, "zip"),
    ("agent_code", "33", "Agent Code", True, 1, 1, 1, "code16"),
    ("agent_licence_no", "34", "Agent Licence No", True, 1, 1, 1, "code16"),
    ("plan_name", "35", "Plan Name", True, 1, 2, 2, "plan_name"),
    ("plan_code", "36", "Plan Code", True, 1, 1, 1, "plan_code"),
    ("sum_of_insured", "37", "Sum Of Insured", True, 1, 1, 1, "money"),
    ("period_of_insurance", "38", "Period Of Insurance", True, 1, 2, 2, "period"),
    ("q1_alcohol", "39", "1. Does the life to be insured consume Alcohol/cigarettes/bidis or tobacco in any form?", True, 1, 1, 1, "yesno"),
    ("q2_medication", "40", "2. Is the life to be insured currently taking any medication or drug?", True, 1, 1, 1, "yesno"),
    ("q3a_hypertension", "41.i", "3. Has the life to be insured ever suffered or is suffering from - i) Hypertension/high blood pressure", True, 1, 1, 1, "yesno"),
    ("q3b_diabetes", "41.ii", "ii) Diabetes or raised blood sugar", True, 1, 1, 1, "yesno"),
    ("q3c_cardiovascular", "41.iii", "iii) Cardiovascular disease, Palpitations, Heart attack, stroke, chest pain", True, 1, 1, 1, "yesno"),
    ("q3d_genitourinary", "41.iv", "iv) Genitourinary diseases e.g. Kidney disorder, Bladder disorder, Urine abnormality, renal stones or genital organ disorder", True, 1, 1, 1, "yesno"),
    ("q4_hiv", "42", "4. Has the life to be insured ever been tested positive for HIV / AIDS, hepatitis B or C or any sexually transmitted disease?", True, 1, 1, 1, "yesno"),
    ("q5_other_insurance", "43", "5. Is the life to be insured currently covered under any health insurance policy with any other company?", True, 1, 1, 1, "yesno"),
    ("q6_involved_pursue", "44", "6. Has the life to be insured ever been involved or is planning to pursue any?", True, 1, 1, 1, "yesno"),
    ("q7_glasses", "45", "7. Does the life to be insured wear glasses?", True, 1, 1, 1, "yesno"),
    ("payment_option", "46", "Payment Option", True, 1, 2, 2, "payment"),
    ("premium", "47", "Premium", True, 1, 1, 1, "money"),
    ("discount", "48", "Discount", True, 1, 1, 1, "money"),
    ("total_amount", "49", "Total Amount", False, None, None, None, None),
    ("card_type", "50", "Card Type", True, 1, 2, 1, "card_type"),
    ("card_no", "51", "Card No", True, 1, 1, 1, "card_no"),
    ("expiry_date", "52", "Expiry Date", True, 1, 1, 1, "na"),
    ("card_holder_name", "53", "Card Holder Name", True, 1, 4, 2, "name"),
    ("transaction_id", "54", "Transaction ID", True, 1, 1, 1, "code16"),
    ("remark", "55", "Remark", False, None, None, None, None),
    ("submit_date", "56", "Submit Date", False, None, None, None, None),
    ("update_date", "57", "Update Date", False, None, None, None, None),
]

# Field keys that exports spell differently.
ALIASES = {
    "ph_name": "policy_holder_name",
    "ph_address": "policy_holder_address",
    "ph_city": "policy_holder_city",
    "ph_state": "policy_holder_state",
    "ph_zip": "policy_holder_zip",
    "ph_phone": "policy_holder_phone",
    "agent_zip": "agent_zip_code",
    "q1_alcohol": "1.does_the_life_to_be_insured_consume_alcohol/cigarettes/bidis_or_tobacco_in_any_form?",
    "q2_medication": "2._is_the_life_to_be_insured_currently_taking_any_medication_or_drug?",
    "q3a_hypertension": "i)_hypertension/high_blood_pressure",
    "q3b_diabetes": "ii)_diabetes_or_raised_blood_sugar",
    "q3c_cardiovascular": "iii)_cardiovascular_disease,_palpitations,_heart_attack,_stroke,_chest_pain",
    "q3d_genitourinary": "iv)_genitourinary_diseases_e.g._kidney_disorder,_bladder_disorder,_urine_abnormality,_renal_stones_or_genital_organ_disorder",
    "q4_hiv": "4.has_the_life_to_be_insured_ever_been_tested_positive_for_hiv_/_aids,_hepatitis_b_or_c_or_any_sexually_transmitted_disease?",
    "q5_other_insurance": "5.is_the_life_to_be_insured_currently_covered_under_any_health_insurance_policy_with_any_other_company?",
    "q6_involved_pursue": "6.has_the_life_to_be_insured_ever_been_involved_or_is_planning_to_pursue_any?",
    "q7_glasses": "7.does_the_life_to_be_insured_wear_glasses?",
}

KEYS = [f[0] for f in FIELDS]
LABEL = {f[0]: f[2] for f in FIELDS}
ON_FORM = [f[0] for f in FIELDS if f[3]]
SCHEMA = "pos int, key string, serial string, label string, on_form boolean, least int, most int, usual int, kind string, alias string"


def field_catalog(spark: SparkSession) -> DataFrame:
    """One row for each field, in the order of the form; alias is the key that exports use."""
    return spark.createDataFrame([(i, *f, ALIASES.get(f[0], f[0])) for i, f in enumerate(FIELDS)], SCHEMA)


def header_names(spark: SparkSession) -> DataFrame:
    """name, key, priority: what a column header may say, in lower case; a smaller priority wins."""
    fields = field_catalog(spark)
    named = [fields.select(F.lower(F.trim(c)).alias("name"), "key", "pos", F.lit(p).alias("priority")) for p, c in enumerate(("key", "label", "alias"))]
    every = named[0].union(named[1]).union(named[2])
    first = F.row_number().over(W.partitionBy("name").orderBy("priority", "pos"))
    return every.withColumn("n", first).where("n = 1").select("name", "key", "priority")
