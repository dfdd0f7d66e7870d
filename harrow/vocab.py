"""Word lists, enumerations and host tables of the posting domain, as plain data."""

ENGINEERING = ["dev", "develop", "developer", "development", "engineer", "engineering", "swe", "sde", "programmer", "researcher", "scientist", "analyst"]
DOMAIN = [
    "software", "system", "systems", "backend", "back-end", "frontend", "front-end", "full-stack", "fullstack", "platform", "web", "mobile", "ios",
    "android", "data", "ai", "ml", "machine learning", "cloud", "infra", "infrastructure", "devops", "sre", "site reliability", "security",
    "automation", "ui", "ux",
]
INTERN = ["intern", "internship", "co-op", "coop", "student"]
ENTRY = ["junior", "entry", "early-career", "new grad", "new graduate", "graduate", "1", "i", "amts", "l1", "l2"]
MID = ["2", "ii", "mid level", "mid-level"]
SENIOR = ["3", "iii", "senior", "sr.", "staff", "principal", "architect", "manager", "director", "distinguished", "lead", "head", "vp", "vice president"]
NON_TECH = [
    "recruiter", "sales", "marketing", "customer success", "business analyst", "finance", "account executive", "operations", "program manager",
    "product marketing", "administrative", "support specialist", "partner manager",
]
JD_KEYWORDS = [
    "minimum qualifications", "preferred qualifications", "basic qualifications", "responsibilities", "requirements", "qualifications",
    "about the job", "about this role", "job description", "what you'll do", "what you will do", "who you are",
]
JD_KEYWORDS_ICIMS = [
    "overview", "responsibilities", "qualifications", "requirements", "what we are looking for", "what you'll do", "what you will do",
    "about the role", "about this role", "job description",
]
COUNTRIES = [
    "USA", "Canada", "UK", "Germany", "Netherlands", "France", "Switzerland", "Sweden", "Denmark", "Norway", "Finland", "Ireland", "Poland",
    "Spain", "Italy", "Portugal", "Australia", "New Zealand", "Singapore", "Japan", "South Korea", "Taiwan", "Hong Kong", "India", "Remote",
    "Unsure", "Other",
]
CATEGORIES = ["summer intern", "off-season intern", "entry level", "mid level", "senior level"]
ATS_HOSTS = [
    ("greenhouse.io", "greenhouse"), ("lever.co", "lever"), ("workdayjobs.com", "workday"), ("ashbyhq.com", "ashby"),
    ("oraclecloud.com", "oraclecloud"), ("smartrecruiters.com", "smartrecruiters"), ("icims.com", "icims"),
]
CUSTOM_HOSTS = [
    ("amazon.jobs", "amazon"), ("microsoft.com", "microsoft"), ("google.com", "google"), ("metacareers.com", "meta"), ("jobs.apple.com", "apple"),
    ("netflix.net", "netflix"), ("tiktok.com", "tiktok"), ("amd.com", "amd"),
]
HOST_ATS = {"stripe.com": "greenhouse"}
ICIMS_PARAMS = ["in_iframe", "mobile", "width", "height", "bga", "needsRedirect", "jan1offset", "jun1offset"]
EXCLUDED_SYMBOLS = ["🛂", "🇺🇸", "🔒"]
#: White space as JavaScript has it, for regular expressions.
JS_SPACE = r"[\t\n\x0B\f\r \u00A0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000\uFEFF]"
#: USD for a million tokens, in and out.
MODEL_PRICES = {"google": (0.3, 2.5), "openai": (1.25, 10.0), "anthropic": (3.0, 15.0)}
GREENHOUSE_NAMES = {
    "mlb.com": "majorleaguebaseball", "digitalocean.com": "digitalocean98", "dltrading.io": "confidentialsportstradingfirm",
    "pinterestcareers.com": "pinterest", "rentptr.com": "premiertruckrental", "zipline.com": "flyzipline",
    "squarepoint-capital.com": "squarepointcapital", "corporate.trustpilot.com": "trustpilot", "c3.ai": "c3iot", "domino-data-lab": "dominodatalab",
}
WORKDAY_NAMES = {"talentmanagementsolution": "jonas"}
ASHBY_NAMES = {"superhuman.com": "Superhuman%20Platform%20Inc"}
ORACLE_NAMES = {
    "fa-ewgu-saasfaprod1.fa.ocs.oraclecloud.com": "Chubb", "ekaw.fa.us2.oraclecloud.com": "Securitas",
    "fa-evmr-saasfaprod1.fa.ocs.oraclecloud.com": "Nokia", "fa-eups-saasfaprod1.fa.ocs.oraclecloud.com": "Ul solutions",
    "hcjy.fa.us2.oraclecloud.com": "CooperSurgical", "ecnf.fa.us2.oraclecloud.com": "Tradeweb", "ibqbjb.fa.ocs.oraclecloud.com": "Honeywell",
    "ecge.fa.us2.oraclecloud.com": "Blue Shield", "edel.fa.us2.oraclecloud.com": "Fortinet", "fa-euxc-saasfaprod1.fa.ocs.oraclecloud.com": "Citco",
    "hccz.fa.em3.oraclecloud.com": "Pearson", "fa-eygo-saasfaprod1.fa.ocs.oraclecloud.com": "Worthington",
    "ejhp.fa.us6.oraclecloud.com": "Sherwin-Williams", "erqh.fa.us2.oraclecloud.com": "Atlantic Health", "edix.fa.us2.oraclecloud.com": "CORSAIR",
    "ebwb.fa.us2.oraclecloud.com": "HOLOGIC", "eofe.fa.us2.oraclecloud.com": "BNY",
}
API = {
    "greenhouse": "https://boards-api.greenhouse.io/v1/boards",
    "smartrecruiters": "https://api.smartrecruiters.com/v1/companies",
    "ashby": "https://api.ashbyhq.com/posting-api/job-board",
    "google": "https://www.google.com/about/careers/applications",
    "meta": "https://www.metacareers.com/jobsearch",
    "apple": "https://jobs.apple.com/en-us/search",
    "netflix": "https://explore.jobs.netflix.net/api/apply/v2/jobs",
    "tiktok": "https://api.lifeattiktok.com/api/v1/public/supplier/search/job/posts",
    "amd": "https://careers.amd.com/careers-home/jobs?lang=en-us",
    "amazon": "https://amazon.jobs/api/jobs/search?is_als=true",
}
CUSTOM_NAMES = {"amazon": "Amazon", "microsoft": "Microsoft", "google": "Google", "meta": "Meta", "apple": "Apple", "netflix": "Netflix", "tiktok": "TikTok", "amd": "AMD"}
