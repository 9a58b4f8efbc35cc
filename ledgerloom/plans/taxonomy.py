"""The taxonomy of merchants and what business sense says of each category: fixed values, and the fold of ordered overrides that makes the prior table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The level2 of each level1.
TAXONOMY = {
    "Food, Tobacco and Liquor Retail": ["Convenience Store", "Supermarket and Hypermarket", "Fresh Produce Retail", "Specialty Food Retail", "Tobacco, Liquor and Tea Retail"],
    "Food and Beverage Services": ["Fast Food and Snacks", "Beverages, Bakery and Coffee", "Cafeteria and Group Dining", "Full-Service Restaurant", "Nightlife Bar and Dining", "Banquet and Large-Scale Catering"],
    "Apparel and General Shopping": ["Apparel, Footwear and Bags", "Department Store", "Shopping Mall", "Outlet Shopping", "Commercial Street Retail"],
    "Housing Payments and Home Improvement Services": ["Utility Bill Payments", "Property Management", "Real Estate and Housing Agency", "Hardware and Building Materials", "Home Furnishings and Textiles", "Building Decoration and Renovation Services", "Appliance, Furniture and Other Repair Services"],
    "Household and Personal Goods Retail": ["Beauty and Personal Care", "Mother and Baby Products and Children's Toys", "Office Supplies", "Flowers and Green Plants", "Pets and Pet Supplies", "Digital Electronics and Home Appliances"],
    "Local Lifestyle and Self-Service Sharing": ["Hair, Beauty and Nail Services", "Bathing, Wellness and Health Services", "Housekeeping and Cleaning Services", "Pet Hospital and Other Pet Services", "Digital and Entertainment Equipment Rental", "Self-Service Sharing Services"],
    "Local Commuting and On-Demand Travel": ["Urban Public Transport", "Shared Two-Wheel Mobility Services", "On-Demand Ride-Hailing", "Designated Driving and Parking Services"],
    "Long-Distance Travel Transport": ["Long-Distance Ground Travel", "Air Travel Services", "Water Sightseeing Transport", "Car Rental", "Expressway Toll and Service Areas"],
    "Vehicle Energy and Automotive Services": ["Fuel Supply Services", "New Energy Charging and Battery Swap Services", "Vehicle Supplies, Repair and Maintenance"],
    "Telecommunications, Logistics and Digital Infrastructure Services": ["Telecom Payment and Operator Services", "Information Search and Online Forums", "Internet Data Services", "Software Development Services", "Express Delivery and Logistics Services", "Basic Postal Services"],
    "Education Payments and Training Services": ["Preschool Care Services", "Primary and Secondary Education", "Higher Education", "Youth Palace and Development Center", "Other Education and Training"],
    "Offline Culture, Sports and Entertainment": ["KTV and Leisure Clubs", "Board Games, Table Games and Gaming Cafes", "Fitness, Yoga and Dance", "Cinema, Performances and Events", "Amusement Parks and Carnivals", "Cultural and Sports Venues", "Books, Media, Arts and Musical Instruments", "Outdoor Sports Equipment"],
    "Online Entertainment and Hobby Spending": ["Online Social Networking", "Online Video, Audio and Reading", "Gaming", "Live Streaming", "Gaming Transactions and Related Services"],
    "Hotels, Scenic Attractions and Tourism Services": ["Hotels, Inns and Homestays", "Scenic Attractions", "Travel Agencies and Tourism Services", "Direct Tourism-Related Services", "Scenic Attraction Touring Services"],
    "Pharmaceutical, Medical Device and Health Retail": ["Pharmaceutical Sales", "Nutrition and Health Products", "Medical Device Sales", "Health and Assistive Therapy Equipment", "Optical Store"],
    "General Clinical Care and Health Management": ["Public Primary Medical Care", "Private Hospital", "Clinics and Independent Practitioners", "Medical Laboratories and Diagnostic Centers", "Health Examinations and Consultations"],
    "Specialized Consumer Medical and Care Services": ["Medical Aesthetics", "Ophthalmic Medical Services", "Dental Medical Services", "Online Medical Services", "Care Institution Services"],
    "High-Value Goods and Professional Services": ["High-Value Jewelry and Accessories", "Wedding and Photography Services", "Advertising, Exhibition and Printing Services", "Legal Services", "Accounting and Financial Consulting Services", "Recruitment Services", "Online Tools"],
}
AGE_LABELS = ("Young Adults", "Middle-aged Adults", "Older Adults")
EDUCATION_LABELS = ("Primary School", "Junior Secondary School", "Senior Secondary School", "Junior College and Above")
# The first prior of each level1: online score, amount, volatility, hours, share of women, ages, educations, occupations.
FIRST = {
    "Food and Beverage Services": (0.18, "low_to_medium", "medium", "7 8 11-13 17-21", 0.50, (0.45, 0.38, 0.17), (0.22, 0.38, 0.20, 0.20), "white_collar|service_worker|family_consumer"),
    "Local Lifestyle and Self-Service Sharing": (0.20, "medium", "medium", "8-22", 0.55, (0.42, 0.42, 0.16), (0.20, 0.38, 0.22, 0.20), "family_consumer|service_worker|white_collar"),
    "Local Commuting and On-Demand Travel": (0.22, "low", "low_to_medium", "6-10 17-21", 0.48, (0.52, 0.35, 0.13), (0.16, 0.36, 0.23, 0.25), "commuter|white_collar|student"),
    "Vehicle Energy and Automotive Services": (0.16, "medium", "low_to_medium", "7-22", 0.36, (0.33, 0.52, 0.15), (0.16, 0.38, 0.24, 0.22), "driver|self_employed|white_collar"),
    "Apparel and General Shopping": (0.60, "medium", "medium", "10-22", 0.62, (0.58, 0.32, 0.10), (0.12, 0.30, 0.23, 0.35), "white_collar|student|self_employed"),
    "High-Value Goods and Professional Services": (0.50, "high", "high", "9-20", 0.48, (0.20, 0.58, 0.22), (0.08, 0.22, 0.25, 0.45), "manager|professional|business_owner"),
    "Household and Personal Goods Retail": (0.55, "medium", "medium", "9-22", 0.58, (0.46, 0.42, 0.12), (0.14, 0.34, 0.24, 0.28), "family_consumer|white_collar|self_employed"),
    "Education Payments and Training Services": (0.42, "high", "medium", "8-21", 0.54, (0.20, 0.62, 0.18), (0.08, 0.24, 0.24, 0.44), "parent|student|teacher"),
    "Hotels, Scenic Attractions and Tourism Services": (0.58, "high", "high", "6-23", 0.50, (0.44, 0.42, 0.14), (0.10, 0.28, 0.24, 0.38), "tourist|white_collar|business_traveler"),
    "Housing Payments and Home Improvement Services": (0.32, "high", "medium", "8-21", 0.50, (0.18, 0.57, 0.25), (0.14, 0.34, 0.24, 0.28), "home_owner|family_consumer|self_employed"),
    "Food, Tobacco and Liquor Retail": (0.26, "low_to_medium", "low", "7-22", 0.50, (0.36, 0.42, 0.22), (0.22, 0.40, 0.20, 0.18), "family_consumer|service_worker|retiree"),
    "Telecommunications, Logistics and Digital Infrastructure Services": (0.68, "low_to_medium", "medium", "8-23", 0.44, (0.56, 0.34, 0.10), (0.10, 0.26, 0.24, 0.40), "white_collar|digital_worker|self_employed"),
    "Online Entertainment and Hobby Spending": (0.88, "low_to_medium", "high", "10-23", 0.46, (0.72, 0.23, 0.05), (0.08, 0.26, 0.25, 0.41), "student|white_collar|digital_worker"),
    "Offline Culture, Sports and Entertainment": (0.22, "low_to_medium", "medium", "9-23", 0.48, (0.58, 0.32, 0.10), (0.12, 0.32, 0.24, 0.32), "student|white_collar|family_consumer"),
    "Pharmaceutical, Medical Device and Health Retail": (0.42, "low_to_medium", "medium", "8-21", 0.55, (0.22, 0.43, 0.35), (0.18, 0.38, 0.22, 0.22), "family_caregiver|retiree|white_collar"),
    "Long-Distance Travel Transport": (0.62, "high", "high", "6-23", 0.48, (0.40, 0.44, 0.16), (0.10, 0.28, 0.24, 0.38), "business_traveler|tourist|driver"),
    "Specialized Consumer Medical and Care Services": (0.22, "high", "high", "8-19", 0.58, (0.26, 0.48, 0.26), (0.12, 0.32, 0.24, 0.32), "patient|family_caregiver|white_collar"),
    "General Clinical Care and Health Management": (0.28, "medium", "medium", "8-18", 0.52, (0.18, 0.42, 0.40), (0.18, 0.38, 0.22, 0.22), "patient|retiree|family_caregiver"),
}
OTHER = (0.50, "medium", "medium", "8-22", 0.50, (0.40, 0.42, 0.18), (0.16, 0.34, 0.23, 0.27), "white_collar|family_consumer|self_employed")
FIRST_BASIS = "behavior_level1 base;2024 online/offline retail anchor"


def has(*words: str) -> str:
    return "(" + " OR ".join(f"contains(level2, '{w.replace(chr(39), chr(39) * 2)}')" for w in words) + ")"


def pick(condition: str, yes: str, no: str) -> str:
    return f"CASE WHEN {condition} THEN {yes} ELSE {no} END"


def n(x: float) -> str:
    return f"{x}::DOUBLE"


# Overrides by words of the level2, in order; later ones win. Settings are values, or SQL (marked by =) on the current state.
OVERRIDES = [
    (has("Online", "Internet", "Software", "Information Search"), {"online": f"=greatest(online, {n(0.78)})", "hours": "9-23", "female": f"=least(greatest(female, {n(0.45)}), {n(0.55)})", "age": (0.66, 0.28, 0.06), "edu": (0.06, 0.22, 0.24, 0.48), "occ": "digital_worker|white_collar|student"}, "digital/online keyword"),
    (has("Gaming", "Board Games"), {"online": "=" + pick(has("Gaming"), n(0.84), n(0.28)), "female": 0.35, "age": (0.76, 0.20, 0.04), "edu": (0.08, 0.28, 0.26, 0.38), "amount": "low_to_medium", "vol": "high", "hours": "12-23", "occ": "student|gamer|white_collar"}, "game/youth male-skew"),
    (has("Live Streaming", "Social Networking", "Video, Audio", "Reading"), {"online": 0.88, "female": 0.50, "age": (0.72, 0.23, 0.05), "amount": "low_to_medium", "vol": "high", "hours": "10-23", "occ": "student|white_collar|content_consumer"}, "online content"),
    (has("Beauty", "Hair", "Nail", "Medical Aesthetics"), {"female": "=" + pick(has("Medical Aesthetics"), n(0.80), n(0.76)), "age": (0.58, 0.35, 0.07), "edu": (0.10, 0.28, 0.24, 0.38), "amount": "=" + pick(has("Medical Aesthetics"), "'high'", "'medium'"), "vol": "=" + pick(has("Medical Aesthetics"), "'high'", "'medium'"), "occ": "white_collar|student|self_employed"}, "beauty/female skew"),
    (has("Mother and Baby", "Children's Toys", "Preschool", "Youth Palace"), {"female": 0.68, "age": (0.18, 0.70, 0.12), "edu": (0.10, 0.28, 0.24, 0.38), "amount": "medium", "vol": "medium", "occ": "parent|teacher|family_consumer"}, "parent/child spending"),
    (has("Fuel", "Vehicle", "Car", "Expressway", "Designated Driving", "Parking", "Charging and Battery Swap"), {"female": 0.35, "age": (0.32, 0.52, 0.16), "edu": (0.14, 0.36, 0.24, 0.26), "occ": "driver|self_employed|business_traveler"}, None),
    (has("Fuel", "Parking", "Expressway"), {"amount": "low_to_medium", "vol": "low_to_medium", "online": 0.15}, None),
    (has("Fuel", "Vehicle", "Car", "Expressway", "Designated Driving", "Parking", "Charging and Battery Swap"), {}, "vehicle/male-skew"),
    (has("Pharmaceutical", "Medical Device", "Health", "Optical", "Nutrition"), {"female": f"=greatest(female, {n(0.55)})", "age": (0.24, 0.42, 0.34), "edu": (0.16, 0.36, 0.23, 0.25), "occ": "family_caregiver|retiree|white_collar"}, "health retail"),
    (has("Dental", "Ophthalmic", "Care Institution", "Clinic", "Hospital", "Health Examination", "Medical Laboratories", "Diagnostic"), {"female": f"=greatest(female, {n(0.54)})", "age": (0.22, 0.46, 0.32), "amount": "high", "vol": "=" + pick(has("Dental", "Ophthalmic", "Medical Laboratories", "Diagnostic"), "'high'", "'medium'"), "edu": (0.12, 0.32, 0.24, 0.32), "occ": "patient|family_caregiver|retiree"}, "medical service"),
    (has("Online Medical"), {"online": 0.78, "female": 0.56, "age": (0.36, 0.46, 0.18), "edu": (0.08, 0.25, 0.24, 0.43), "hours": "8-23", "occ": "patient|white_collar|family_caregiver"}, "online medical"),
    (has("Hotel", "Inn", "Homestay", "Travel Agency", "Direct Tourism-Related Services", "Air Travel", "Rail", "Long-Distance Ground Travel", "Water Transport"), {"online": f"=greatest(online, {n(0.62)})", "amount": "high", "vol": "high", "female": 0.50, "age": (0.42, 0.44, 0.14), "edu": (0.08, 0.26, 0.24, 0.42), "hours": "6-23", "occ": "tourist|business_traveler|white_collar"}, "travel booking"),
    (has("Scenic Attractions", "Amusement Park", "Carnival"), {"online": f"=least(online, {n(0.28)})", "amount": "medium", "vol": "high", "female": 0.50, "age": (0.46, 0.40, 0.14), "edu": (0.12, 0.30, 0.24, 0.34), "hours": "8-21", "occ": "tourist|family_consumer|student"}, "offline attraction"),
    (has("Higher Education"), {"age": (0.46, 0.42, 0.12), "edu": (0.04, 0.18, 0.24, 0.54), "amount": "high", "occ": "student|parent|teacher"}, "higher education"),
    (f"(NOT {has('Higher Education')} AND {has('Education', 'Training')})", {"age": (0.18, 0.66, 0.16), "edu": (0.08, 0.24, 0.25, 0.43), "amount": "high", "occ": "parent|student|teacher"}, "education/training"),
    (has("Real Estate", "Housing", "Property Management", "Renovation", "Building Materials", "Hardware", "Home Furnishings", "Home Textiles", "Repair"), {"age": (0.16, 0.58, 0.26), "amount": "=" + pick(has("Repair"), "'medium'", "'high'"), "vol": "medium", "female": "=" + pick(has("Home Furnishings", "Home Textiles"), n(0.52), n(0.48)), "edu": (0.12, 0.34, 0.24, 0.30), "occ": "home_owner|family_consumer|self_employed"}, "home/property"),
    (has("Legal", "Accounting", "Financial Consulting", "Advertising", "Exhibition", "Recruitment"), {"age": (0.18, 0.62, 0.20), "edu": (0.04, 0.18, 0.24, 0.54), "amount": "high", "vol": "high", "female": 0.48, "occ": "professional|manager|business_owner"}, "professional service"),
    (has("Funeral"), {"online": 0.15, "female": 0.48, "age": (0.10, 0.48, 0.42), "edu": (0.20, 0.40, 0.22, 0.18), "amount": "high", "vol": "high", "hours": "8-18", "occ": "family_consumer|retiree|service_worker"}, "funeral/offline"),
    (has("Convenience", "Fresh Produce", "Food", "Supermarket and Hypermarket", "Tobacco, Liquor", "Tea"), {"online": "=" + pick(has("Convenience"), n(0.18), n(0.26)), "amount": "low_to_medium", "vol": "low_to_medium", "age": (0.34, 0.43, 0.23), "edu": (0.22, 0.40, 0.20, 0.18), "occ": "family_consumer|service_worker|retiree"}, "daily retail"),
    (has("3C", "Digital Electronics", "Home Appliances", "Office Supplies"), {"online": 0.68, "female": 0.42, "age": (0.56, 0.34, 0.10), "edu": (0.08, 0.24, 0.24, 0.44), "amount": "=" + pick(has("3C", "Home Appliances"), "'high'", "'medium'"), "vol": "medium", "occ": "white_collar|student|digital_worker"}, "electronics/office"),
    (has("Pet"), {"female": 0.58, "age": (0.48, 0.40, 0.12), "edu": (0.10, 0.28, 0.25, 0.37), "amount": "medium", "vol": "medium", "occ": "white_collar|family_consumer|student"}, "pet economy"),
    (has("Flowers", "Green Plants", "Wedding", "Photography"), {"female": 0.60, "age": (0.48, 0.42, 0.10), "edu": (0.10, 0.28, 0.25, 0.37), "amount": "medium", "vol": "high", "occ": "white_collar|family_consumer|self_employed"}, "occasion/lifestyle"),
    (has("Apparel", "Footwear and Bags", "Outlet Shopping", "Department Store", "Shopping Mall", "Commercial Street Retail"), {"female": "=" + pick(has("Apparel", "Footwear and Bags"), n(0.62), n(0.56)), "age": (0.56, 0.34, 0.10), "edu": (0.12, 0.30, 0.23, 0.35), "amount": "medium", "vol": "medium", "occ": "white_collar|student|family_consumer"}, "fashion/shopping"),
    (has("KTV", "Bar"), {"female": 0.45, "age": (0.68, 0.26, 0.06), "amount": "medium", "vol": "high", "hours": "18-23", "occ": "student|white_collar|service_worker"}, "night entertainment"),
    (has("Fitness", "Yoga", "Dance", "Outdoor Sports"), {"female": 0.52, "age": (0.62, 0.32, 0.06), "amount": "medium", "vol": "medium", "edu": (0.10, 0.28, 0.24, 0.38), "occ": "white_collar|student|fitness_enthusiast"}, "sports/fitness"),
    (has("Cultural and Sports Venues", "Cinema", "Performance", "Events", "Books, Media", "Musical Instruments"), {"female": 0.50, "age": (0.56, 0.34, 0.10), "amount": "low_to_medium", "vol": "medium", "edu": (0.10, 0.28, 0.24, 0.38), "occ": "student|white_collar|family_consumer"}, "culture/entertainment"),
    (has("Public Transport", "Shared Two-Wheel"), {"online": 0.18, "amount": "low", "vol": "low", "age": (0.58, 0.32, 0.10), "occ": "commuter|student|white_collar"}, "daily commute"),
    (has("Ride-Hailing"), {"online": 0.40, "amount": "low_to_medium", "vol": "medium", "age": (0.52, 0.38, 0.10), "occ": "commuter|white_collar|tourist"}, "ride hailing"),
]
# Industries of each occupation.
WHOLESALE, HEALTH, PUBLIC, SOFTWARE = "Wholesale and Retail Trade", "Health and Social Work", "Public Administration, Social Security and Social Organizations", "Information Transmission, Software and Information Technology Services"
FINANCE, SCIENCE, LODGING, RESIDENT = "Financial Services", "Scientific Research and Technical Services", "Accommodation and Food Services", "Resident Services, Repair and Other Services"
FACTORY, BUILDING, TRANSPORT, LEASING = "Manufacturing", "Construction", "Transport, Storage and Postal Services", "Leasing and Business Services"
CULTURE, ESTATE = "Culture, Sports and Entertainment", "Real Estate"
INDUSTRIES = {
    "white_collar": [FINANCE, SOFTWARE, SCIENCE, PUBLIC], "service_worker": [LODGING, RESIDENT, WHOLESALE], "family_consumer": ["Education", HEALTH, PUBLIC, WHOLESALE], "commuter": [FACTORY, BUILDING, TRANSPORT],
    "student": ["Education"], "teacher": ["Education"], "parent": ["Education", HEALTH, PUBLIC], "driver": [TRANSPORT, BUILDING, FACTORY], "self_employed": [WHOLESALE, LEASING, RESIDENT], "manager": [FINANCE, LEASING, PUBLIC],
    "professional": [SCIENCE, FINANCE, SOFTWARE], "business_owner": [LEASING, WHOLESALE, ESTATE], "digital_worker": [SOFTWARE, SCIENCE], "patient": [HEALTH, PUBLIC], "family_caregiver": [HEALTH, "Education", PUBLIC], "retiree": [PUBLIC, HEALTH],
    "tourist": [LODGING, TRANSPORT, CULTURE], "business_traveler": [TRANSPORT, LEASING, FINANCE], "gamer": [SOFTWARE, CULTURE], "content_consumer": [CULTURE, SOFTWARE], "home_owner": [ESTATE, BUILDING, RESIDENT], "fitness_enthusiast": [CULTURE, HEALTH],
}
INDUSTRY_LABELS = tuple(sorted({i for own in INDUSTRIES.values() for i in own}))
# level2 that carry more risk.
RISKY = ("Information Search and Online Forums", "Online Social Networking", "Online Video, Audio and Reading", "Internet Data Services", "Gaming", "Live Streaming", "Nutrition and Health Products", "Hair, Beauty and Nail Services", "Medical Aesthetics", "High-Value Jewelry and Accessories", "Online Tools", "Travel Agencies and Tourism Services",
    "Direct Tourism-Related Services", "Telecom Payment and Operator Services", "Digital Electronics and Home Appliances", "Digital and Entertainment Equipment Rental", "Appliance, Furniture and Other Repair Services", "Nightlife Bar and Dining", "KTV and Leisure Clubs")
STATE = ("online", "amount", "vol", "hours", "female", "age", "edu", "occ")


def hour_list(text: str) -> list[int]:
    """Hours of ranges as text: "7 8 11-13"."""
    ends = [[int(x) for x in part.split("-")] for part in text.split()]
    return sorted({h for e in ends for h in range(e[0], e[-1] + 1)})


def literal(name: str, value) -> str:
    """A setting as SQL of both engines."""
    if isinstance(value, str) and value.startswith("="):
        return value[1:]
    if name == "hours":
        value = ",".join(map(str, hour_list(value)))
    if isinstance(value, tuple):
        return f"array({', '.join(n(v) for v in value)})"
    return f"'{value}'" if isinstance(value, str) else n(value)


def industry_shares(occ: str) -> list[float]:
    """Shares of INDUSTRY_LABELS for occupations as text; unknown ones count nothing."""
    out = dict.fromkeys(INDUSTRY_LABELS, 0.0)
    for token in occ.split("|"):
        for i in INDUSTRIES.get(token, ()):
            out[i] += 1 / len(INDUSTRIES[token])
    total = sum(out.values())
    return [out[i] / total if total else 0.0 for i in INDUSTRY_LABELS]


def first_sql(i: int) -> str:
    cases = " ".join(f"WHEN '{c}' THEN {literal(STATE[i], v[i])}" for c, v in FIRST.items())
    return f"CASE level1 {cases} ELSE {literal(STATE[i], OTHER[i])} END"


def keyword_priors(pairs: DataFrame) -> DataFrame:
    """The prior of each (level1, level2): the level1's first values, then every override whose words the level2 has, in order, and the trail of those that spoke.

    The fold is over columns: an override sees the state that the ones before it left. The taxonomy is small; callers may broadcast the result.
    """
    rows = pairs.select("level1", "level2").distinct().withColumns({c: F.expr(first_sql(i)) for i, c in enumerate(STATE)} | {"basis": F.lit(FIRST_BASIS)})
    for condition, settings, basis in OVERRIDES:
        speaks = F.expr(condition)
        new = {c: F.when(speaks, F.expr(literal(c, v))).otherwise(F.col(c)) for c, v in settings.items()}
        if basis:
            new["basis"] = F.when(speaks, F.concat("basis", F.lit(f";{basis}"))).otherwise(F.col("basis"))
        rows = rows.withColumns(new)
    known = sorted({v[7] for v in FIRST.values()} | {OTHER[7]} | {s["occ"] for _, s, _ in OVERRIDES if "occ" in s})
    shares: Column = F.create_map(*[x for o in known for x in (F.lit(o), F.array(*[F.lit(v) for v in industry_shares(o)]))])
    rows = rows.withColumn("industries", F.element_at(shares, F.col("occ")))
    bucket = F.when(F.col("online") >= 0.75, "strong_online").when(F.col("online") >= 0.55, "mixed_online").when(F.col("online") >= 0.35, "mixed_offline").otherwise("strong_offline")
    return rows.withColumns({"online": F.round("online", 3), "female": F.round("female", 3), "bucket": bucket})


def priors_sql(pairs: str) -> str:
    """The same as CTEs for DuckDB; the last one is `kp`."""
    duck = lambda x: x.replace("array(", "list_value(")
    out = [f"o0 AS (SELECT DISTINCT level1, level2, {', '.join(f'{duck(first_sql(i))} AS {c}' for i, c in enumerate(STATE))}, '{FIRST_BASIS}' AS basis FROM {pairs})"]
    for i, (condition, settings, basis) in enumerate(OVERRIDES, 1):
        new = [f"CASE WHEN {condition} THEN {duck(literal(c, v))} ELSE {c} END AS {c}" for c, v in settings.items()]
        new += [f"CASE WHEN {condition} THEN basis || ';{basis}' ELSE basis END AS basis"] if basis else []
        out.append(f"o{i} AS (SELECT * REPLACE ({', '.join(new)}) FROM o{i - 1})")
    known = sorted({v[7] for v in FIRST.values()} | {OTHER[7]} | {s["occ"] for _, s, _ in OVERRIDES if "occ" in s})
    table = ", ".join(f"('{o}', [{', '.join(n(v) for v in industry_shares(o))}])" for o in known)
    out.append(f"kp AS (SELECT level1, level2, round(online, 3) AS online, amount, vol, hours, round(female, 3) AS female, age, edu, occ, basis, industries, CASE WHEN online >= 0.75 THEN 'strong_online' WHEN online >= 0.55 THEN 'mixed_online' WHEN online >= 0.35 THEN 'mixed_offline' ELSE 'strong_offline' END AS bucket FROM o{len(OVERRIDES)} JOIN (VALUES {table}) x(occ, industries) USING (occ))")
    return ", ".join(out)
