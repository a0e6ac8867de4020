"""Lookup tables and lists that results depend on, stated plainly and in their natural order."""

US_STATES = {
    "alabama": "AL", "alaska": "AK", "arizona": "AZ", "arkansas": "AR", "california": "CA", "colorado": "CO", "connecticut": "CT", "delaware": "DE", "florida": "FL", "georgia": "GA", "hawaii": "HI", "idaho": "ID",
    "illinois": "IL", "indiana": "IN", "iowa": "IA", "kansas": "KS", "kentucky": "KY", "louisiana": "LA", "maine": "ME", "maryland": "MD", "massachusetts": "MA", "michigan": "MI", "minnesota": "MN", "mississippi": "MS",
    "missouri": "MO", "montana": "MT", "nebraska": "NE", "nevada": "NV", "new hampshire": "NH", "new jersey": "NJ", "new mexico": "NM", "new york": "NY", "north carolina": "NC", "north dakota": "ND", "ohio": "OH", "oklahoma": "OK",
    "oregon": "OR", "pennsylvania": "PA", "rhode island": "RI", "south carolina": "SC", "south dakota": "SD", "tennessee": "TN", "texas": "TX", "utah": "UT", "vermont": "VT", "virginia": "VA", "washington": "WA", "west virginia": "WV",
    "wisconsin": "WI", "wyoming": "WY", "district of columbia": "DC",
}
CA_PROVINCES = {
    "alberta": "AB", "british columbia": "BC", "manitoba": "MB", "new brunswick": "NB", "newfoundland and labrador": "NL", "newfoundland": "NL", "nova scotia": "NS", "northwest territories": "NT", "nunavut": "NU",
    "ontario": "ON", "prince edward island": "PE", "quebec": "QC", "saskatchewan": "SK", "yukon": "YT",
}
#: Postal-code letters of the provinces.
PROVINCE_PREFIXES = {
    "BC": ["V"], "AB": ["T"], "SK": ["S"], "MB": ["R"], "ON": ["K", "L", "M", "N", "P"], "QC": ["G", "H", "J"], "NB": ["E"], "NS": ["B"], "PE": ["C"], "NL": ["A"], "YT": ["Y"], "NT": ["X"], "NU": ["X"],
}
#: Bounds of rates by state: 95th and 99th percentile of energy, fixed and demand rates; None for all other states.
RATE_BOUNDS = {
    None: (0.35, 0.60, 50.0, 150.0, 30.0, 80.0),
    "HI": (0.50, 0.80, 30.0, 100.0, 40.0, 100.0), "CT": (0.40, 0.65, 30.0, 100.0, 30.0, 80.0), "MA": (0.40, 0.65, 20.0, 80.0, 30.0, 80.0), "RI": (0.40, 0.65, 20.0, 80.0, 30.0, 80.0),
    "NH": (0.35, 0.55, 25.0, 80.0, 30.0, 80.0), "CA": (0.55, 0.80, 20.0, 80.0, 30.0, 80.0), "AK": (0.40, 0.65, 30.0, 100.0, 30.0, 80.0), "NY": (0.35, 0.55, 30.0, 100.0, 30.0, 80.0), "NJ": (0.30, 0.50, 20.0, 80.0, 30.0, 80.0),
    "TX": (0.25, 0.45, 20.0, 80.0, 25.0, 70.0), "FL": (0.25, 0.40, 20.0, 80.0, 25.0, 70.0), "IL": (0.25, 0.45, 20.0, 80.0, 25.0, 70.0),
    "WA": (0.20, 0.35, 25.0, 80.0, 20.0, 60.0), "OR": (0.20, 0.35, 20.0, 80.0, 20.0, 60.0), "ID": (0.18, 0.30, 20.0, 80.0, 20.0, 60.0), "LA": (0.20, 0.35, 20.0, 80.0, 20.0, 60.0), "AR": (0.20, 0.35, 20.0, 80.0, 20.0, 60.0),
    "WY": (0.20, 0.35, 20.0, 80.0, 20.0, 60.0), "UT": (0.20, 0.35, 15.0, 60.0, 20.0, 60.0),
    "ON": (0.25, 0.40, 40.0, 120.0, 20.0, 60.0), "BC": (0.20, 0.35, 20.0, 80.0, 15.0, 50.0), "AB": (0.30, 0.50, 30.0, 100.0, 20.0, 60.0), "QC": (0.15, 0.25, 25.0, 80.0, 15.0, 50.0),
}
#: Groups of states that are worked through one after another.
STATE_BATCHES = {
    "Pacific NW + Islands": ["WA", "OR", "AK", "HI"], "California + Nevada": ["CA", "NV"], "Mountain West": ["AZ", "CO", "ID", "MT", "NM", "UT", "WY"], "Texas": ["TX"], "Northern Plains": ["MN", "ND", "SD", "NE"],
    "Heartland": ["IA", "KS", "MO", "OK"], "South Central": ["AR", "LA", "MS"], "Deep South": ["AL", "GA"], "Southeast": ["FL", "NC", "SC"], "Upper South": ["TN", "KY", "WV"], "Great Lakes": ["WI", "MI"],
    "Ohio Valley": ["OH", "IN", "IL"], "Mid-Atlantic": ["PA", "NJ", "VA", "MD", "DE", "DC"], "New York": ["NY"], "New England": ["MA", "CT", "ME", "VT", "NH", "RI"],
}
OWNERSHIP = {
    "Investor Owned": "iou", "Municipal": "municipal", "Cooperative": "cooperative", "Political Subdivision": "political_subdivision", "Federal": "federal", "State": "state",
    "Retail Power Marketer": "retail_marketer", "Behind the Meter": "behind_meter", "Community Choice Aggregator": "community_choice",
}
#: Sites that compare or republish rates of many utilities.
THIRD_PARTY_DOMAINS = [
    "wikipedia.org", "yelp.com", "yellowpages.com", "bbb.org", "facebook.com", "twitter.com", "linkedin.com", "reddit.com", "nextdoor.com", "glassdoor.com", "mapquest.com", "opb.org", "prnewswire.com", "businesswire.com", "koin.com",
    "azfamily.com", "ecowatch.com", "openei.org", "utility-rates.com", "costcheckusa.com", "findenergy.com", "energysage.com", "choosetexaspower.org", "electricityplans.com", "saveonenergy.com", "electricrate.com", "wattbuy.com",
    "energybot.com", "electricitylocal.com", "energypal.com", "electricchoice.com", "paylesspower.com", "texaselectricityratings.com", "powertochoose.org", "electricityrates.com", "utilitygenius.com", "switchwise.com", "energyrates.ca",
    "ratehub.ca", "chooseenergy.com", "smartenergyusa.com", "gatby.com", "poweroutage.us", "njenergyratings.com", "energypricing.com", "power2switch.com", "homeotter.com", "nyenergyratings.com", "texaschoicepower.com",
    "compareelectricity.com", "electricalratesgeorgia.com", "electricityrate.com", "gotelectric.com", "ratetruth.com", "comparepower.com", "ohenergyratings.com", "vaultelectricity.com", "maenergyratings.com", "energysavings.com",
    "getcurrents.com", "utilitiesformyhome.com", "uselectricgrid.com", "qmerit.com", "xoomenergy.com", "ilagg.com", "ilenergyratings.com", "goananta.com", "solar.com", "nrgcleanpower.com", "greenridgesolar.com", "madison.com", "sandboxsolar.com",
]
#: Patterns of urls and titles of pages that compare prices.
COMPARISON_PAGES = [
    r"comparison[-_]of[-_]electricity", r"comparison[-_]electricity[-_]prices", r"comparing[-_]electricity", r"electricity[-_]rate[s]?[-_]comparison", r"rate[-_]comparison", r"average[-_]electricity[-_]rates",
    r"electricity[-_]prices[-_]\d{4}",
]
#: Names in tariffs that show whose they are.
OTHER_UTILITIES = [
    "penelec", "met-ed", "met ed", "metropolitan edison", "duquesne light", "west penn power", "ppl electric", "aep ohio", "aep texas", "appalachian power", "first energy", "firstenergy", "ohio edison", "the illuminating company",
    "toledo edison", "national grid", "eversource", "pseg", "pse&g", "jersey central power", "atlantic city electric", "delmarva power", "pepco", "bge", "baltimore gas", "consolidated edison", "con edison", "con ed", "central hudson",
    "orange and rockland", "centerpoint energy", "oncor", "aep central", "tnmp", "txu energy", "reliant energy", "georgia power", "alabama power", "mississippi power", "duke energy", "progress energy", "dominion energy",
    "dominion virginia", "pacific gas", "pg&e", "pge", "southern california edison", "sce", "san diego gas", "sdg&e", "xcel energy", "northern states power",
]
#: Spellings of rate types that count as complex.
COMPLEX_TYPES = [
    "tiered_demand", "demand_tiered", "tiered_demand_seasonal", "seasonal_demand", "demand_seasonal", "seasonal_tiered_demand", "seasonal_tou_tiered", "seasonal_tou_demand", "tou_demand",
]
