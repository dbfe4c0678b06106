"""Word lists and patterns that fix the meaning of the text operators.

Larger dictionaries (place gazetteer, canonical skill variants, verified company
sizes) are inputs: the operators that use them take a DataFrame.
"""

# --- fixed values: skill types -------------------------------------------------
SKILL_TYPES = [
    ("tech_stack", "Tech Stack"),
    ("technical_skill", "Technical Skill"),
    ("soft_skill", "Soft Skill"),
]

# --- fixed values: job keywords seeded into an empty keyword table -------------
JOB_KEYWORDS = [
    "Data Analyst", "Data Scientist", "Data Engineer", "Data Developer", "Data Architect",
    "Data Specialist", "Business Intelligence", "Machine Learning", "AI Engineer",
    "AI Research", "AI Scientist", "AI Developer", "Prompt Engineer", "NLP Engineer",
    "Computer Vision", "Deep Learning Engineer",
]

# --- fixed values: role filter on posting titles -------------------------------
ROLE_TERMS = [
    "data scientist", "data engineer", "data analyst", "data analyst engineer",
    "machine learning", "ml engineer", "ai engineer", "artificial intelligence",
    "deep learning", "big data", "computer vision", "nlp",
    "natural language processing", "business intelligence", "analytics",
    "data mining", "data pipeline", "etl", "data warehouse",
    "data architect", "data specialist", "analytics engineer",
]
ROLE_EXCLUSIONS = [
    "accountant", "auditor", "sales", "business development", "marketing manager", "economist",
]

# --- fixed values: job title cleaning ------------------------------------------
SENIORITY_WORDS = [
    "junior", "senior", "lead", "intern", "staff", "associate", "manager", "director",
    "principal", "head", "chief", "expert", "specialist", "officer", "sr", "jr",
]
TITLE_SUFFIX_PATTERNS = [
    r"\s*-\s*(remote|contract|full.?time|part.?time|hybrid|onsite|wfo).*$",
    r"\s*\(.*?(remote|contract|full.?time|part.?time|hybrid|onsite)\.*\).*$",
    r"\s*\[.*\].*$",
    r",\s*(remote|relocation).*$",
]
TITLE_ACRONYMS = ["ML", "AI", "NLP", "ETL", "BI", "CV"]
TITLE_REJECTS = [
    "software engineer", "frontend", "backend", "fullstack", "android", "ios", "mobile",
    "web developer", "devops", "qa engineer", "quality assurance", "sales", "marketing",
    "business development", "hr ", "human resource", "accounting", "electrical engineer",
    "civil engineer", "mechanical engineer", "driver", "warehouse",
]

# --- fixed values: reasons stored with a rejected title -------------------------
TITLE_REASON_EXCLUDED = "Termasuk priority reject keywords"
TITLE_REASON_REJECTED = "Tidak cocok dengan keywords di database"

# --- fixed values: short location vocabulary (city > province > country) --------
SHORT_CITIES = [
    "jakarta", "bandung", "surabaya", "malang", "medan", "makassar", "palembang", "semarang",
    "yogyakarta", "solo", "bogor", "depok", "tangerang", "bekasi", "sidoarjo", "gresik",
    "pasuruan", "batu", "kudus", "pekalongan", "tegal", "kota lama", "karawang", "subang",
    "cilegon", "serang", "cirebon", "magelang", "salatiga", "klaten", "boyolali", "sukoharjo",
    "purworejo", "wonosobo", "kebumen", "cilacap", "bumiayu", "brebes", "purwokerto",
    "banyumas", "banjarmasin", "balikpapan", "pontianak", "denpasar", "ubud",
]
SHORT_PLACES = [
    ("jakarta", "Jakarta"), ("bandung", "Bandung"), ("surabaya", "Surabaya"),
    ("malang", "Malang"), ("medan", "Medan"), ("makassar", "Makassar"),
    ("palembang", "Palembang"), ("semarang", "Semarang"), ("yogyakarta", "Yogyakarta"),
    ("solo", "Solo"), ("bogor", "Bogor"), ("depok", "Depok"), ("tangerang", "Tangerang"),
    ("bekasi", "Bekasi"), ("sidoarjo", "Sidoarjo"), ("gresik", "Gresik"),
    ("pasuruan", "Pasuruan"), ("denpasar", "Denpasar"), ("ubud", "Ubud"),
    ("banjarmasin", "Banjarmasin"), ("balikpapan", "Balikpapan"), ("pontianak", "Pontianak"),
    ("jawa barat", "Jawa Barat"), ("jawa timur", "Jawa Timur"), ("jawa tengah", "Jawa Tengah"),
    ("sumatera utara", "Sumatera Utara"), ("sumatera selatan", "Sumatera Selatan"),
    ("kalimantan", "Kalimantan"), ("sulawesi", "Sulawesi"), ("bali", "Bali"), ("papua", "Papua"),
    ("indonesia", "Indonesia"), ("nationwide", "Indonesia"),
    ("remote", "Remote"), ("work from home", "Remote"), ("wfh", "Remote"),
]
SHORT_REMOTE = ["remote", "work from home", "wfh"]

# --- fixed values: full location normaliser -------------------------------------
LOCATION_NOISE = [
    "remote", "online", "hybrid", "work from home", "wfh", "freelance", "contract",
    "part-time", "temporary", "onsite", "office", "full-time", "full time", "telecommute",
]
LOCATION_COUNTRY = "Indonesia"
PROVINCE_ALIASES = [
    ("WEST JAVA", "JAWA BARAT"), ("CENTRAL JAVA", "JAWA TENGAH"), ("EAST JAVA", "JAWA TIMUR"),
    ("WEST KALIMANTAN", "KALIMANTAN BARAT"), ("CENTRAL KALIMANTAN", "KALIMANTAN TENGAH"),
    ("SOUTH KALIMANTAN", "KALIMANTAN SELATAN"), ("EAST KALIMANTAN", "KALIMANTAN TIMUR"),
    ("NORTH KALIMANTAN", "KALIMANTAN UTARA"), ("NORTH SULAWESI", "SULAWESI UTARA"),
    ("CENTRAL SULAWESI", "SULAWESI TENGAH"), ("SOUTH SULAWESI", "SULAWESI SELATAN"),
    ("WEST SULAWESI", "SULAWESI BARAT"), ("SOUTHEAST SULAWESI", "SULAWESI TENGGARA"),
    ("NORTH SUMATRA", "SUMATERA UTARA"), ("WEST SUMATRA", "SUMATERA BARAT"),
    ("SOUTH SUMATRA", "SUMATERA SELATAN"), ("NORTH MALUKU", "MALUKU UTARA"),
    ("WEST PAPUA", "PAPUA BARAT"), ("SPECIAL CAPITAL REGION OF JAKARTA", "DKI JAKARTA"),
    ("DKI", "DKI JAKARTA"), ("SPECIAL REGION OF YOGYAKARTA", "DI YOGYAKARTA"),
    ("DIY", "DI YOGYAKARTA"),
]
CITY_ALIASES = [
    ("WEST JAKARTA", "JAKARTA BARAT"), ("EAST JAKARTA", "JAKARTA TIMUR"),
    ("SOUTH JAKARTA", "JAKARTA SELATAN"), ("NORTH JAKARTA", "JAKARTA UTARA"),
    ("CENTRAL JAKARTA", "JAKARTA PUSAT"), ("SOUTH TANGERANG", "TANGERANG SELATAN"),
    ("WEST BANDUNG", "BANDUNG BARAT"), ("WEST LOMBOK", "LOMBOK BARAT"),
    ("CENTRAL LOMBOK", "LOMBOK TENGAH"), ("EAST LOMBOK", "LOMBOK TIMUR"),
    ("NORTH LOMBOK", "LOMBOK UTARA"),
]
PLACE_PREFIX_PATTERN = r"^(KOTA|KABUPATEN|PROVINSI|DAERAH ISTIMEWA|DAERAH|ISTIMEWA)\s+"
PLACE_SECOND_PREFIX_PATTERN = r"^(KOTA|KABUPATEN|PROVINSI)\s+"

# --- fixed values: company sizes -------------------------------------------------
SIZE_RANGES = [
    (0, 10, "1-10"), (11, 50, "11-50"), (51, 200, "51-200"), (201, 500, "201-500"),
    (501, 1000, "501-1000"), (1001, 5000, "1001-5000"), (5001, 10000, "5001-10000"),
    (10001, None, "10001+"),
]
SIZE_LABELS_COMMA = [
    "1-10", "11-50", "51-200", "201-500", "501-1,000", "1,001-5,000", "5,001-10,000", "10,001+",
]
SIZE_TEXT_PATTERNS = [
    (r"^1[-–]10$", "1-10"),
    (r"^11[-–]50$", "11-50"),
    (r"^51[-–]200$", "51-200"),
    (r"^201[-–]500$", "201-500"),
    (r"^501[-–]1[,.]?000$", "501-1,000"),
    (r"^1[,.]?001[-–]5[,.]?000$", "1,001-5,000"),
    (r"^5[,.]?001[-–]10[,.]?000$", "5,001-10,000"),
    (r"^10[,.]?001\+?$", "10,001+"),
    (r"^1\s+to\s+10$", "1-10"),
    (r"^11\s+to\s+50$", "11-50"),
    (r"^51\s+to\s+200$", "51-200"),
    (r"^201\s+to\s+500$", "201-500"),
    (r"^501\s+to\s+1[,.]?000$", "501-1,000"),
    (r"^1[,.]?001\s+to\s+5[,.]?000$", "1,001-5,000"),
    (r"^5[,.]?001\s+to\s+10[,.]?000$", "5,001-10,000"),
    (r"(?:under|less\s+than)\s*50\b", "11-50"),
    (r"(?:under|less\s+than)\s*200\b", "51-200"),
    (r"^25[-–]100$", "11-50"),
    (r"^100[-–]500$", "201-500"),
    (r"^500[-–]1[,.]?000$", "501-1,000"),
    (r"^1[,.]?000[-–]5[,.]?000$", "1,001-5,000"),
]
SIZE_NUMBER = r"(?:\d{1,3}(?:[,\.]\d{3})*|\d+)"
_SIZE_RANGE = rf"{SIZE_NUMBER}(?:\s*[-–]\s*{SIZE_NUMBER}|\+)"
_SIZE_SPAN = rf"{SIZE_NUMBER}\s+to\s+{SIZE_NUMBER}"
# wordings of a head count, tried in this order; the size is the first group
SIZE_WORDINGS = [
    rf"(?i)({_SIZE_RANGE}|{_SIZE_SPAN})\s*(?:employees?|karyawan|staff)\b",
    r"(?i)(?:company\s*size|ukuran\s*perusahaan|number\s+of\s+employees?|employees?)[:\s]+"
    rf"({_SIZE_RANGE}|{_SIZE_SPAN}|{SIZE_NUMBER})",
    rf"(?i)({SIZE_NUMBER})\s+total\s+employees?",
    rf"(?i)(?:has|employs|with|approximately|~|about)\s+({SIZE_NUMBER}[kKmM]?)\s+"
    r"(?:total\s+)?(?:employees?|staff|karyawan)",
    rf'(?i)"(?:numberOfEmployees|employeeCount)"\s*[:"]+\s*({_SIZE_RANGE}|{SIZE_NUMBER})',
]
SIZE_PAGE_PATTERNS = [
    r"(?i)\d{1,3}(?:[,.]\d{3})*\s*[-–]\s*\d{1,3}(?:[,.]\d{3})*\s*(?:karyawan|employees?|人)",
    r"(?i)\d+(?:rb)?\s*[-–]\s*\d+(?:rb)?\s*(?:karyawan|employees?)",
    r"规模[：:]\s*\d{1,3}(?:[,.]\d{3})*\s*[-–]\s*\d{1,3}(?:[,.]\d{3})*",
]
_STAFF_NUMBER = r"(?:\d{1,3}(?:[.,]\d{3})+|\d+(?:[.,]\d+)?[kKmM]?)"
_STAFF_RANGE = rf"{_STAFF_NUMBER}(?:\s*[-–]\s*{_STAFF_NUMBER})?\+?"
STAFF_WORDINGS = [
    r"(?i)(?:ukuran perusahaan|company size|jumlah karyawan|number of employees|employee count|headcount)"
    rf"\s*[:\-]?\s*({_STAFF_RANGE})\s*(?:karyawan|employees?)?",
    rf"(?i)({_STAFF_RANGE})\s*(?:karyawan|employees?)",
    r"(?i)company\s*size[:\s]+([^\n\r<]{2,100})",
]
STAFF_KEYS = ["numberOfEmployees", "employees", "member", "memberCount"]
SIZE_PAGE_LABELS = ["ukuran perusahaan", "company size", "规模", "公司规模"]
LARGE_COMPANY_WORDS = [
    "bank", "insurance", "telkom", "pertamina", "pln", "shopee", "tokopedia", "gojek", "grab",
    "lazada", "indofood", "astra", "unilever", "kalbe", "schneider",
]

# --- fixed values: company names and company pages --------------------------------
CORPORATE_SUFFIXES = [
    "bv", "co", "co.", "corp", "corporation", "cv", "cv.", "gmbh", "inc", "inc.", "llc", "ltd",
    "ltd.", "plc", "pt", "pt.", "pte", "pte.", "sa", "sdn", "spa", "tbk", "persero",
]
SHORT_CORPORATE_SUFFIXES = ["inc", "ltd", "llc", "corp", "corporation", "co", "sa", "gmbh", "pt"]
REGIONAL_WORDS = [
    "asia", "china", "emea", "hong kong", "india", "indonesia", "japan", "korea", "malaysia",
    "philippines", "singapore", "south east asia", "southeast asia", "thailand", "taiwan",
    "vietnam",
]
IGNORED_NAME_WORDS = ["by", "official", "the", "and", "of"]
SLUG_NOISE_PATTERN = (
    r"\b(?:pt|tbk|cv|ltd|inc|llc|co|corp|group|indonesia|division|technologies?|teknologi|"
    r"solutions?|services?|digital|global|financial|network|networks?|consulting|system|"
    r"systems?|internasional|international)\b"
)
SLUG_STOPWORDS = ["the", "and", "for", "dengan", "dari"]
NAME_STOPWORDS = [
    "the", "and", "of", "for", "in", "pt", "tbk", "cv", "ltd", "inc", "co", "group", "indonesia",
    "division", "noodle", "financial", "technologies", "technology", "consulting", "digital",
    "global", "solutions", "services", "network", "networks",
]
TITLE_STOPWORDS = NAME_STOPWORDS + ["sistem", "teknik"]
LOGIN_WALL_MARKERS = [
    "join linkedin", "sign in", "security verification", "let's do a quick security check",
    "challenge", "captcha",
]
COMPANY_URL_PATTERN = r"(?i)https?://(?:[a-z]{2,3}\.)?linkedin\.com/company/"
COMPANY_URL_PREFIX = "https://www.linkedin.com/company/"
JOB_URL_PREFIX = "https://www.linkedin.com/jobs/view/"

# --- fixed values: page elements and keys that are read ---------------------------
LINK_KEYS = ["url", "hiringOrganization", "organizer"]
CARD_LINK = ("a", "base-card__full-link")
CARD_TITLE = ("h3", "base-search-card__title")
CARD_COMPANY = ("h4", "base-search-card__subtitle")
CARD_LOCATION = ("span", "job-search-card__location")
# (tag, class, id) in the order they are tried
DESCRIPTION_ELEMENTS = [
    ("div", "show-more-less-html__markup", None),
    ("div", "description", None),
    ("section", None, "description"),
    ("div", "job-details-jobs-unified-top-card__job-insight", None),
]
DESCRIPTION_MINIMUM = 100

# --- fixed values: skill classification -------------------------------------------
GENERIC_TERMS = [
    "databases", "database", "cloud", "data", "analytics", "ai", "ml", "programming", "coding",
    "development", "services", "platform", "tools", "applications", "software", "systems",
    "infrastructure", "network",
]
SOFT_SKILL_INDICATORS = [
    "communication", "leadership", "teamwork", "collaboration", "problem solving",
    "analytical thinking", "critical thinking", "time management", "adaptability", "creativity",
    "emotional intelligence", "negotiation", "presentation", "writing", "attention to detail",
    "organization", "conflict resolution", "decision making", "customer service",
    "interpersonal skills", "self motivation", "work ethic", "stress management", "multitasking",
    "interpersonal",
    "komunikasi", "kepemimpinan", "kerjasama", "manajemen waktu", "pemecahan masalah",
    "berpikir analitis", "kemampuan analisis", "analisis", "berpikir kritis", "kreativitas",
    "negosiasi", "presentasi", "ketelitian", "perhatian terhadap detail", "resolusi konflik",
    "pengambilan keputusan", "layanan pelanggan", "keterampilan interpersonal", "motivasi diri",
    "etos kerja", "profesionalisme", "manajemen stres", "multitugas", "empati", "kemampuan",
    "kerja tim", "tim", "waktu", "kritis",
]
SOFT_SKILL_PHRASES = [
    "problem solving", "analytical thinking", "analytical skill", "critical thinking",
    "communication", "leadership", "teamwork", "team work", "team player", "collaboration",
    "time management", "adaptability", "adaptable", "creativity", "creative thinking",
    "emotional intelligence", "negotiation", "presentation skill", "writing skill",
    "report writing", "attention to detail", "organization skill", "organizational skill",
    "conflict resolution", "decision making", "customer service", "interpersonal",
    "self motivation", "work ethic", "stress management", "multitasking",
    "pemecahan masalah", "berpikir analitis", "berpikir kritis", "komunikasi", "kepemimpinan",
    "kerja tim", "kerja sama tim", "kolaborasi", "manajemen waktu", "kemampuan beradaptasi",
    "adaptasi", "kreativitas", "kecerdasan emosional", "negosiasi", "kemampuan presentasi",
    "ketelitian", "manajemen organisasi", "resolusi konflik", "pengambilan keputusan",
    "layanan pelanggan", "keterampilan interpersonal", "motivasi diri", "etos kerja",
    "manajemen stres", "multitugas",
]

# --- fixed values: Indonesian skill phrases -> English ----------------------------
INDONESIAN_SKILLS = [
    ("kemampuan analisis", "analytical thinking"),
    ("berpikir analitis", "analytical thinking"),
    ("analisis", "analytical thinking"),
    ("pemecahan masalah", "problem solving"),
    ("kemampuan pemecahan masalah", "problem solving"),
    ("berpikir kritis", "critical thinking"),
    ("komunikasi", "communication"),
    ("kemampuan komunikasi", "communication"),
    ("kepemimpinan", "leadership"),
    ("kemampuan kepemimpinan", "leadership"),
    ("kerja tim", "teamwork"),
    ("kerjasama", "teamwork"),
    ("kemampuan bekerja sama dalam tim", "teamwork"),
    ("manajemen waktu", "time management"),
    ("kemampuan beradaptasi", "adaptability"),
    ("adaptasi", "adaptability"),
    ("kreativitas", "creativity"),
    ("negosiasi", "negotiation"),
    ("kemampuan presentasi", "presentation"),
    ("presentasi", "presentation"),
    ("ketelitian", "attention to detail"),
    ("perhatian terhadap detail", "attention to detail"),
    ("resolusi konflik", "conflict resolution"),
    ("pengambilan keputusan", "decision making"),
    ("layanan pelanggan", "customer service"),
    ("keterampilan interpersonal", "interpersonal skills"),
    ("motivasi diri", "self motivation"),
    ("etos kerja", "work ethic"),
    ("profesionalisme", "work ethic"),
    ("manajemen stres", "stress management"),
    ("kelola stres", "stress management"),
    ("multitugas", "multitasking"),
    ("pengaturan waktu", "time management"),
]

# --- fixed values: direct spelling fixes -> canonical name ------------------------
SPECIFIC_FIXES = [
    ("python3", "Python"), ("py", "Python"), ("js", "JavaScript"), ("nodejs", "JavaScript"),
    ("golang", "Go"), ("csharp", "C#"), ("aws", "AWS"), ("gcp", "Google Cloud Platform"),
    ("azure", "Microsoft Azure"), ("big query", "Google BigQuery"), ("postgres", "PostgreSQL"),
    ("psql", "PostgreSQL"), ("mongo", "MongoDB"), ("mssql", "Microsoft SQL Server"),
    ("sql server", "Microsoft SQL Server"), ("sklearn", "Scikit-learn"), ("tf", "TensorFlow"),
    ("torch", "PyTorch"), ("pd", "Pandas"), ("np", "NumPy"), ("ml", "Machine Learning"),
    ("nlp", "NLP"), ("llm", "LLM Engineering"), ("rag", "RAG"), ("etl", "ETL Process"),
    ("elt", "ETL Process"), ("tdd", "Test-Driven Development"), ("ci cd", "CI/CD"),
    ("ci/cd", "CI/CD"), ("mlops", "Model Deployment"), ("ms excel", "Excel"),
    ("microsoft excel", "Excel"), ("excel 365", "Excel"), ("advanced excel", "Excel"),
    ("kemampuan analisis", "Analytical Thinking"), ("berpikir analitis", "Analytical Thinking"),
    ("analisis", "Analytical Thinking"), ("pemecahan masalah", "Problem Solving"),
    ("berpikir kritis", "Critical Thinking"), ("komunikasi", "Communication"),
    ("kepemimpinan", "Leadership"), ("kerja tim", "Teamwork"), ("kerjasama", "Teamwork"),
    ("manajemen waktu", "Time Management"), ("kemampuan beradaptasi", "Adaptability"),
    ("adaptasi", "Adaptability"), ("kreativitas", "Creativity"), ("negosiasi", "Negotiation"),
    ("presentasi", "Presentation Skills"), ("ketelitian", "Attention to Detail"),
    ("perhatian terhadap detail", "Attention to Detail"),
    ("resolusi konflik", "Conflict Resolution"), ("pengambilan keputusan", "Decision Making"),
    ("layanan pelanggan", "Customer Service"),
    ("keterampilan interpersonal", "Interpersonal Skills"), ("motivasi diri", "Self-Motivation"),
    ("etos kerja", "Work Ethic"), ("profesionalisme", "Work Ethic"),
    ("manajemen stres", "Stress Management"), ("multitugas", "Multitasking"),
]

# --- fixed values: synonyms, in lookup order --------------------------------------
SYNONYMS = [
    ("komunikasi", "communication"), ("kemampuan komunikasi", "communication"),
    ("kepemimpinan", "leadership"), ("kemampuan kepemimpinan", "leadership"),
    ("kerja tim", "teamwork"), ("kerjasama", "teamwork"), ("kerja sama", "teamwork"),
    ("team work", "teamwork"), ("pemecahan masalah", "problem solving"),
    ("kemampuan pemecahan masalah", "problem solving"), ("problem-solving", "problem solving"),
    ("manajemen waktu", "time management"), ("pengaturan waktu", "time management"),
    ("berpikir analitis", "analytical thinking"), ("kemampuan analisis", "analytical thinking"),
    ("analisis", "analytical thinking"), ("analytical", "analytical thinking"),
    ("berpikir kritis", "critical thinking"), ("critical", "critical thinking"),
    ("kreativitas", "creativity"), ("creative", "creativity"),
    ("adaptabilitas", "adaptability"), ("adaptasi", "adaptability"),
    ("flexibility", "adaptability"), ("negosiasi", "negotiation"),
    ("presentasi", "presentation"), ("public speaking", "presentation"),
    ("ketelitian", "attention to detail"),
    ("perhatian terhadap detail", "attention to detail"),
    ("detail oriented", "attention to detail"), ("resolusi konflik", "conflict resolution"),
    ("conflict management", "conflict resolution"),
    ("pengambilan keputusan", "decision making"), ("decision-making", "decision making"),
    ("layanan pelanggan", "customer service"), ("customer support", "customer service"),
    ("keterampilan interpersonal", "interpersonal skills"),
    ("interpersonal", "interpersonal skills"), ("people skills", "interpersonal skills"),
    ("motivasi diri", "self motivation"), ("self-motivation", "self motivation"),
    ("etos kerja", "work ethic"), ("professionalism", "work ethic"),
    ("manajemen stres", "stress management"), ("stress management", "stress management"),
    ("multitugas", "multitasking"),
    ("machine learning", "machine learning"), ("ml", "machine learning"),
    ("deep learning", "deep learning"), ("neural network", "deep learning"),
    ("natural language processing", "nlp"), ("nlp", "nlp"),
    ("computer vision", "computer vision"), ("cv", "computer vision"),
    ("data engineering", "data engineering"), ("data pipeline", "data pipeline"),
    ("etl", "etl process"), ("elt", "etl process"), ("data warehouse", "data warehouse"),
    ("data lake", "data lake"), ("business intelligence", "business intelligence"),
    ("bi", "business intelligence"), ("data analysis", "data analysis"),
    ("data analytics", "data analysis"), ("data visualization", "data visualization"),
    ("dataviz", "data visualization"),
    ("python3", "python"), ("py", "python"), ("js", "javascript"), ("nodejs", "javascript"),
    ("golang", "go"), ("csharp", "c#"), ("aws", "aws"), ("amazon web services", "aws"),
    ("gcp", "google cloud platform"), ("google cloud", "google cloud platform"),
    ("azure", "microsoft azure"), ("postgres", "postgresql"), ("psql", "postgresql"),
    ("mongo", "mongodb"), ("sql server", "microsoft sql server"),
    ("mssql", "microsoft sql server"), ("sklearn", "scikit-learn"), ("tf", "tensorflow"),
    ("torch", "pytorch"), ("pd", "pandas"), ("np", "numpy"), ("excel", "excel"),
    ("ms excel", "excel"), ("microsoft excel", "excel"), ("tableau", "tableau"),
    ("powerbi", "power bi"), ("power bi", "power bi"),
]
SYNONYM_SCORE = 100.0
FUZZY_THRESHOLD = 85
VOCABULARY_THRESHOLD = 80

# --- fixed values: known abbreviations for the grounding check ---------------------
SKILL_ALIASES = [
    ("machine learning", ["ml"]),
    ("deep learning", ["dl"]),
    ("natural language processing", ["nlp"]),
    ("artificial intelligence", ["ai"]),
    ("javascript", ["js"]),
    ("typescript", ["ts"]),
    ("continuous integration", ["ci/cd", "ci cd", "ci"]),
    ("continuous deployment", ["ci/cd", "ci cd", "cd"]),
    ("ci/cd", ["ci cd", "continuous integration", "continuous deployment"]),
    ("user interface", ["ui"]),
    ("user experience", ["ux"]),
    ("object oriented programming", ["oop"]),
    ("structured query language", ["sql"]),
    ("amazon web services", ["aws"]),
    ("google cloud platform", ["gcp"]),
    ("computer vision", ["cv"]),
    ("extract transform load", ["etl"]),
]
