"""Word lists, classes and patterns that results depend on.

Each block below is text in its natural order: one class a line, ``name: term | term``, the first class winning ties.
"""

from __future__ import annotations


def _classes(block: str) -> dict[str, list[str]]:
    found = {}
    for line in block.strip().splitlines():
        name, _, terms = line.strip().partition(": ")
        found[name] = terms.split(" | ")
    return found


# --- fixed values: words -------------------------------------------------------------------------------

#: Substrings of the served language vote.
VOTE_WORDS = "le la les un une et de du des à ce cette".split()

#: Frequent words of the combined language detector.
FRENCH_COMMON = """
le de et à un il être en avoir que pour dans ce son une sur avec ne se pas tout plus par grand je qui du elle au sont ils
mais nous vous votre cette faire leur si peut dire ses temps très lui vont voir fait celle voire deux même autre après
seulement nom aussi voici bien où voilà vers pendant contre tous homme ici moins maintenant sans moi année monde jour
monsieur demander entre première venir passer peu lequel suite bon comprendre depuis point ainsi heure rester savoir
aller devant ville chaque donner rien chose pourquoi notre donc alors fin nouveau cas route pont voiture train bus avion
europe afrique pays gouvernement partir place groupe partie prendre eau travail devoir vie système mettre important
mot chercher premier personne semaine mois cause loi programme société marché politique peuple Maroc exemple penser
situation différent mer cours publique plan étude question suivant organisé développer président communauté culture
changer école cinquante région souvent exister résultat action répondre organization activité kilomètre information
entreprise
""".split()

ARABIC_COMMON = """
في من إلى على عن أن هذا هذه ذلك كانت قد كل بعض عند حيث متى لكن حتى إذا بل لا ليس مع قبل بعد خلال
طريق شارع محطة مطار ميناء رصيف جسر نفق سيارة حافلة قطار شاحنة دراجة دراجة_نارية مترو ترامواي سفينة طائرة
مرور ازدحام إشارة توقف سرعة ممنوع مسموح خطر سلامة حزام وقود طاقة ديزل بنزين كهرباء بطارية صيانة إصلاح حجز تذكرة
تحميل تفريغ شحن نقل مستودع مخزن بضاعة حاوية طرد طرود وزارة حكومة شرطة مراقبة قانون مكتب إدارة
المغرب الرباط الدار_البيضاء مراكش فاس طنجة أكادير وجدة مكناس تطوان الصويرة ورزازات الناظور العيون الداخلة
عقد اتفاقية مذكرة قرار مرسوم إعلان طلب استمارة وثيقة شهادة ترخيص فاتورة وصل مذكرة_خدمة محضر ملف
تقرير مراسلة بريد ختم تأشيرة دفتر_التحملات كراسة_الشروط عطاء مناقصة
""".split()

#: Stop words of the quality checks.
FRENCH_STOP_QUALITY = """
le de et à un il être en avoir que pour dans ce son une sur avec ne se pas tout plus par grand je qui du elle au sont
ils mais nous vous votre
""".split()

ARABIC_STOP_QUALITY = """
في من إلى على أن هذا هذه التي الذي كان كانت يكون تكون وقد قد لقد كل بعض جميع عند عندما حيث أين كيف ماذا متى لماذا لكن
لكي حتى إذا لو أم أما إما بل لا ليس
""".split()

#: Stop words of the document keywords.
FRENCH_STOP_KEYWORDS = """
le de un à être et en avoir que pour dans ce il une sur avec ne se pas tout plus par grand mais si ou son du les des
""".split()

ARABIC_STOP_KEYWORDS = "في من إلى على عن مع كل هذا هذه ذلك التي الذي وهي وهو كما لكن أن".split()

#: Stop words of the section keywords.
SECTION_STOP = "dans avec pour sont cette plus tout comme على في من إلى هذا هذه التي الذي".split()

# --- fixed values: characters --------------------------------------------------------------------------

ACCENTED_FR = "àâäçéèêëïîôùûüÿñæœÀÂÄÇÉÈÊËÏÎÔÙÛÜŸÑÆŒ"
ACCENTED_LOWER = "àâäéèêëïîôöùûüÿñç"
LATIN_FR = "a-zA-ZàâäéèêëïîôöùûüçÀÂÄÉÈÊËÏÎÔÖÙÛÜÇ"
PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
DETECTOR_PUNCTUATION = PUNCTUATION + "،؛؟«»"
QUALITY_PUNCTUATION = DETECTOR_PUNCTUATION + "؍"

# --- fixed values: patterns of the language detector ----------------------------------------------------

FRENCH_PATTERNS = (
    "[àâäéèêëïîôöùûüÿñç]",
    r"\b(le|la|les|un|une|des|du|de|ce|cette|ces|et|ou|mais|donc|ni|car)\b",
    r"\b(je|tu|il|elle|nous|vous|ils|elles)\b",
    r"\b(avoir|être|faire|aller|dire|venir|voir|savoir|vouloir)\b",
)
ARABIC_LETTERS = "ابتثجحخدذرزسشصضطظعغفقكلمنهوي"
ARABIC_HAMZA = "أإآؤئءة"

# --- fixed values: document types by keyword (weight 2) and pattern (weight 3) ----------------------------

TYPE_KEYWORDS_FR = _classes("""
cahier_charges: cahier des charges | appel d'offres | marché public | consultation | soumissionnaire | candidat | prestation | fourniture | travaux | spécifications techniques | critères d'évaluation | délai d'exécution
rapport: rapport | bilan | évaluation | analyse | étude | diagnostic | recommandations | conclusions | synthèse | état des lieux | performance | résultats | indicateurs
arrete_decret: arrêté | décret | ministre | secrétaire d'état | dispositions | article | vu le | considérant | arrête | décrète | journal officiel | publication | abrogé | modifié
circulaire: circulaire | instruction | directive | note de service | application | mise en œuvre | procédure | modalités
contrat: contrat | convention | accord | partenariat | engagement | parties | obligations | durée | résiliation | clause
""")
TYPE_PATTERNS_FR = {
    "cahier_charges": [r"cahier\s+des?\s+charges?", r"appel\s+d[']offres?", r"marché\s+public", r"consultation\s+publique"],
    "rapport": [r"rapport\s+(annuel|mensuel|trimestriel|d[']activité)", r"bilan\s+d[']activité", r"évaluation\s+des?\s+performances?"],
    "arrete_decret": [r"arrêté\s+(ministériel|n°)", r"décret\s+(n°|du)", r"vu\s+le\s+décret", r"journal\s+officiel"],
    "circulaire": [r"circulaire\s+n°", r"note\s+de\s+service", r"instruction\s+ministérielle"],
    "contrat": [r"contrat\s+de", r"convention\s+de", r"accord\s+de\s+partenariat"],
}
TYPE_KEYWORDS_AR = _classes("""
cahier_charges: دفتر التحملات | طلب عروض | صفقة عمومية | استشارة | مترشح | مقدم العرض | خدمة | توريد | أشغال | المواصفات التقنية | معايير التقييم | آجال التنفيذ | المناقصة
rapport: تقرير | حصيلة | تقييم | تحليل | دراسة | تشخيص | توصيات | خلاصات | ملخص | وضعية | أداء | نتائج | مؤشرات
arrete_decret: قرار | مرسوم | وزير | كاتب الدولة | مقتضيات | مادة | بناء على | اعتبارا | يقرر | يرسم | الجريدة الرسمية | نشر | ملغى | معدل
circulaire: منشور | تعليمة | توجيه | مذكرة خدمة | تطبيق | تفعيل | إجراء | كيفيات
contrat: عقد | اتفاقية | اتفاق | شراكة | التزام | أطراف | التزامات | مدة | فسخ | بند
""")
TYPE_PATTERNS_AR = {
    "cahier_charges": [r"دفتر\s+التحملات", r"طلب\s+عروض", r"صفقة\s+عمومية", r"استشارة\s+عمومية"],
    "rapport": [r"تقرير\s+(سنوي|شهري|فصلي|النشاط)", r"حصيلة\s+النشاط", r"تقييم\s+الأداء"],
    "arrete_decret": [r"قرار\s+(وزاري|رقم)", r"مرسوم\s+(رقم|بتاريخ)", r"بناء\s+على\s+المرسوم", r"الجريدة\s+الرسمية"],
    "circulaire": [r"منشور\s+رقم", r"مذكرة\s+خدمة", r"تعليمة\s+وزارية"],
    "contrat": [r"عقد\s+", r"اتفاقية\s+", r"اتفاق\s+شراكة"],
}

# --- fixed values: sectors (weight 1) -------------------------------------------------------------------

SECTORS_FR = _classes("""
transports_routiers: transport routier | autoroute | route nationale | circulation routière | permis de conduire | véhicule | camion | bus | autocar | sécurité routière | code de la route | signalisation | voiture | NARSA
logistique: logistique | chaîne d'approvisionnement | entreposage | stockage | distribution | supply chain | flux de marchandises | plateforme logistique | AMDL | SNTL
transport_aerien: transport aérien | aviation | aéroport | compagnie aérienne | avion | vol | navigation aérienne | contrôle aérien | sécurité aérienne | aviation civile | AIAC | ONDA | RAM
marine_marchande: marine marchande | transport maritime | port | navire | bateau | maritime | shipping | fret maritime | armateur | capitainerie | ISEM
transport_ferroviaire: transport ferroviaire | chemin de fer | train | ONCF | gare | voie ferrée | locomotive | wagon | rail | infrastructure ferroviaire
gouvernance: gouvernance | politique publique | administration | ministère | direction générale | réforme | stratégie | pilotage | coordination
""")
SECTORS_AR = _classes("""
transports_routiers: النقل الطرقي | الطريق السيار | الطريق الوطنية | حركة المرور | رخصة السياقة | مركبة | شاحنة | حافلة | أوتوكار | السلامة الطرقية | مدونة السير | الإشارات المرورية
logistique: اللوجستيك | سلسلة التموين | التخزين | المستودعات | التوزيع | تدفق البضائع | المنصة اللوجستيكية
transport_aerien: النقل الجوي | الطيران | مطار | شركة طيران | طائرة | رحلة | الملاحة الجوية | المراقبة الجوية | السلامة الجوية | الطيران المدني
marine_marchande: الأسطول التجاري | النقل البحري | ميناء | سفينة | باخرة | بحري | الشحن البحري | مالك السفينة | قبطانية الميناء
transport_ferroviaire: النقل بالسكك الحديدية | السكة الحديدية | قطار | المكتب الوطني للسكك الحديدية | محطة | خط السكة الحديدية | قاطرة | عربة | سكة | البنية التحتية للسكك الحديدية
gouvernance: الحكامة | السياسة العمومية | الإدارة | وزارة | المديرية العامة | إصلاح | استراتيجية | قيادة | تنسيق
""")
SECTOR_DEFAULT = "gouvernance"

# --- fixed values: metadata classes by pattern (weight 1) --------------------------------------------------

METADATA_TYPES = {
    "regulation": [r"arrêté|décret|circulaire|directive", r"قرار|مرسوم|منشور|توجيه", r"article\s+\d+|chapitre\s+\d+", r"المادة\s+\d+|الفصل\s+\d+"],
    "report": [r"rapport|étude|analyse|bilan", r"تقرير|دراسة|تحليل|حصيلة", r"résultats|conclusions|recommandations", r"النتائج|الخلاصات|التوصيات"],
    "memo": [r"note|mémo|correspondance", r"مذكرة|مراسلة", r"objet|référence", r"الموضوع|المرجع"],
    "procedure": [r"procédure|manuel|guide|instruction", r"إجراء|دليل|تعليمة", r"étape|processus|méthode", r"خطوة|عملية|طريقة"],
    "contract": [r"contrat|accord|convention|marché", r"عقد|اتفاق|اتفاقية|صفقة", r"partie contractante|signataire", r"الطرف المتعاقد|الموقع"],
    "budget": [r"budget|financement|coût|prix", r"ميزانية|تمويل|كلفة|سعر", r"dépense|recette|allocation", r"نفقة|إيراد|مخصص"],
}
METADATA_CATEGORIES = {
    "legal": [r"loi|juridique|légal|réglementation", r"قانون|قانوني|تشريع", r"tribunal|cour|justice", r"محكمة|عدالة"],
    "technical": [r"technique|ingénierie|spécification", r"تقني|هندسة|مواصفات", r"norme|standard|qualité", r"معيار|جودة"],
    "administrative": [r"administratif|gestion|organisation", r"إداري|تسيير|تنظيم", r"personnel|ressources humaines", r"موظفين|موارد بشرية"],
    "financial": [r"financier|comptable|fiscal", r"مالي|محاسبي|جبائي", r"trésorerie|comptabilité", r"خزينة|محاسبة"],
}
METADATA_DEPARTMENTS = {
    "transport_routier": [r"transport routier|route|autoroute", r"النقل البري|طريق|طريق سيار"],
    "transport_ferroviaire": [r"transport ferroviaire|train|chemin de fer", r"النقل بالسكك الحديدية|قطار"],
    "transport_aerien": [r"transport aérien|aviation|aéroport", r"النقل الجوي|طيران|مطار"],
    "transport_maritime": [r"transport maritime|port|navigation", r"النقل البحري|ميناء|ملاحة"],
    "logistique": [r"logistique|chaîne d'approvisionnement", r"اللوجستيك|سلسلة التموين"],
}
STATUSES = {
    "draft": r"brouillon|draft|مسودة",
    "final": r"final|définitif|نهائي",
    "approved": r"approuvé|approved|موافق عليه",
    "under_review": r"en révision|under review|قيد المراجعة",
    "obsolete": r"obsolète|deprecated|ملغى",
}
VERSION_PATTERNS = (r"version\s+(\d+\.?\d*)", r"v\.?\s*(\d+\.?\d*)", r"révision\s+(\d+)", r"النسخة\s+(\d+\.?\d*)")
TRANSPORT_TERMS = (
    r"transport\w*", r"route\w*", r"circulation", r"traffic", r"véhicule\w*", r"autoroute\w*", r"infrastructure\w*",
    r"sécurité", r"réglementation", r"logistique", r"port\w*", r"aéroport\w*", r"gare\w*",
    r"نقل", r"طريق", r"مرور", r"حركة", r"مركبة", r"طريق سيار", r"بنية تحتية", r"أمن", r"تنظيم", r"لوجستيك", r"ميناء", r"مطار", r"محطة",
)

# --- fixed values: structure counters ---------------------------------------------------------------------

TOC_PATTERNS = (r"table\s+des?\s+matières?", r"sommaire", r"index", r"فهرس\s+المحتويات?", r"المحتويات")
SECTION_PATTERNS = (r"chapitre\s+\d+", r"section\s+\d+", r"article\s+\d+", r"الفصل\s+\d+", r"القسم\s+\d+", r"المادة\s+\d+")
TABLE_PATTERNS = (r"tableau\s+\d+", r"\[table\]", r"جدول\s+\d+", r"الجدول\s+\d+")
FIGURE_PATTERNS = (r"figure\s+\d+", r"fig\.\s+\d+", r"شكل\s+\d+", r"الشكل\s+\d+")
REFERENCE_PATTERNS = (r"référence\s*:", r"voir\s+aussi", r"cf\.", r"مرجع\s*:", r"انظر\s+أيضا")
BIBLIOGRAPHY_PATTERNS = (r"bibliographie", r"références?", r"sources?", r"المراجع", r"المصادر")
APPENDIX_PATTERNS = (r"annexe\w*", r"appendice\w*", r"الملاحق?", r"المرفقات?")

# --- fixed values: entities; where a pattern has a group, the group is what is returned ---------------------

MONTHS_FR = "janvier|février|mars|avril|mai|juin|juillet|août|septembre|octobre|novembre|décembre"
MONTHS_AR = "يناير|فبراير|مارس|أبريل|ماي|يونيو|يوليوز|غشت|شتنبر|أكتوبر|نونبر|دجنبر"
MONTHS_AR_PARSED = "يناير|فبراير|مارس|أبريل|مايو|يونيو|يوليو|أغسطس|سبتمبر|أكتوبر|نوفمبر|ديسمبر"

DATES_FR = (
    (r"\b\d{1,2}[\/\-\.]\d{1,2}[\/\-\.]\d{4}\b", 0),
    (rf"\b\d{{1,2}}\s+({MONTHS_FR})\s+\d{{4}}\b", 1),
    (rf"\b({MONTHS_FR})\s+\d{{4}}\b", 1),
    (r"\b\d{4}\b", 0),
)
DATES_AR = (
    (r"\b\d{1,2}[\/\-\.]\d{1,2}[\/\-\.]\d{4}\b", 0),
    (rf"\b\d{{1,2}}\s+({MONTHS_AR})\s+\d{{4}}\b", 1),
    (rf"\b({MONTHS_AR})\s+\d{{4}}\b", 1),
    (r"\bسنة\s+\d{4}\b", 0),
    (r"\b\d{4}\s+هـ\b", 0),
)
REFERENCES_FR = (
    (r"\bn°\s*\d+[\-\/]\d+", 0),
    (r"\b(arrêté|décret|circulaire)\s+n°\s*[\d\-\/A-Z]+", 1),
    (r"\bréférence\s*:\s*[\w\-\/]+", 0),
    (r"\b[A-Z]{2,}\s*\d+[\-\/]\d+", 0),
)
REFERENCES_AR = (
    (r"\bرقم\s*\d+[\-\/]\d+", 0),
    (r"\b(قرار|مرسوم|منشور)\s+رقم\s*[\d\-\/أ-ي]+", 1),
    (r"\bمرجع\s*:\s*[\w\-\/]+", 0),
    (r"\b[أ-ي]{2,}\s*\d+[\-\/]\d+", 0),
)
PLACES_FR = (
    (r"\b(Rabat|Casablanca|Marrakech|Fès|Tanger|Agadir|Meknès|Oujda|Kenitra|Tétouan|Salé)\b", 1),
    (r"\b(région|province|préfecture)\s+de\s+\w+", 1),
    (r"\baéroport\s+(Mohammed V|de Rabat-Salé|de Marrakech)", 1),
    (r"\bport\s+de\s+(Casablanca|Tanger|Agadir)", 1),
)
PLACES_AR = (
    (r"\b(الرباط|الدار البيضاء|مراكش|فاس|طنجة|أكادير|مكناس|وجدة|القنيطرة|تطوان|سلا)\b", 1),
    (r"\b(جهة|إقليم|عمالة)\s+\w+", 1),
    (r"\bmطار\s+(محمد الخامس|الرباط سلا|مراكش)", 1),
    (r"\bميناء\s+(الدار البيضاء|طنجة|أكادير)", 1),
)
PERSONS_AR = (r"\b[أ-ي]{3,}\s+[أ-ي]{3,}\b",)
ORGANISATIONS_AR = (r"وزارة\s+[أ-ي\s]+", r"المديرية\s+العامة\s+[أ-ي\s]+", r"المكتب\s+الوطني\s+[أ-ي\s]+")
APPROVAL_CONTEXT = ("approuvé", "adopté", "موافق عليه")
EFFECTIVE_CONTEXT = ("effectif", "entrée en vigueur", "ساري المفعول")

# --- fixed values: cleaning -------------------------------------------------------------------------------

#: In the order applied.
MOJIBAKE = (
    ("Ã ", "à"), ("Ã¡", "á"), ("Ã¢", "â"), ("Ã¨", "è"), ("Ã©", "é"), ("Ãª", "ê"), ("Ã¬", "ì"), ("Ã­", "í"), ("Ã®", "î"),
    ("Ã²", "ò"), ("Ã³", "ó"), ("Ã´", "ô"), ("Ã¹", "ù"), ("Ãº", "ú"), ("Ã»", "û"), ("Ã§", "ç"),
    ("â€™", "'"), ("â€œ", '"'), ("â€", '"'),
)

#: Applied in order, ignoring case.
OCR_FIXES = (
    (r"\br\s+n\b", "rn"), (r"\bm\s+e\b", "me"), (r"\bt\s+e\b", "te"), (r"\bl\s+e\b", "le"), (r"\bd\s+e\b", "de"),
    (r"\bc\s+e\b", "ce"), (r"\bq\s+u\s+e\b", "que"), (r"\bp\s+o\s+u\s+r\b", "pour"),
    (r"(?<!\w)rn(?!\w)", "m"), (r"(?<!\w)cl(?=\s|$)", "d"), (r"(?<!\w)ri(?=\s|$)", "n"), (r"(?<!\w)vv(?!\w)", "w"),
    (r"(?<!\w)ه\s+ا(?!\w)", "ها"), (r"(?<!\w)ا\s+ل(?!\w)", "ال"), (r"(?<!\w)م\s+ن(?!\w)", "من"), (r"(?<!\w)ف\s+ي(?!\w)", "في"),
)

#: Matched at the start of a stripped line, ignoring case.
HEADER_FOOTER = (
    r"^Page\s+\d+(\s+(sur|of|من)\s+\d+)?$", r"^MINISTÈRE.*$", r"^وزارة.*$", r"^ROYAUME\s+DU\s+MAROC.*$", r"^المملكة\s+المغربية.*$",
    r"^\d{2}/\d{2}/\d{4}.*$", r"^.*@.*\.ma$", r"^Tél\.?\s*:.*$", r"^هاتف\s*:.*$", r"^B\.P\.?\s*\d+.*$", r"^ص\.ب\.?\s*\d+.*$",
    r"^.*CONFIDENTIEL.*$", r"^.*سري.*$",
)
NOISE_LINES = (
    r"^[^\w\s]*$", r"^\s*[.]{3,}\s*$", r"^\s*[-]{3,}\s*$", r"^\s*[=]{3,}\s*$", r"^\s*[_]{3,}\s*$", r"^\s*\|\s*\|\s*\|\s*$",
    r"^\s*[\+\-\|]{3,}\s*$",
)
ELISIONS = tuple("d l qu n s c j t m".split())

# --- fixed values: document structure ---------------------------------------------------------------------

HEADINGS = {
    "french": (
        r"^(TITRE|CHAPITRE|SECTION|ARTICLE|ANNEXE)\s+([IVXLCDM]+|\d+)",
        r"^(\d+\.(?:\d+\.)*)\s+(.+)",
        r"^([A-Z][^.!?]*):?\s*$",
        r"^(Introduction|Conclusion|Résumé|Préambule)",
    ),
    "arabic": (
        r"^(العنوان|الفصل|القسم|المادة|الملحق)\s+(\d+)",
        r"^(\d+\.(?:\d+\.)*)\s+(.+)",
        r"^(المقدمة|الخاتمة|الملخص|التمهيد)",
    ),
    "universal": (r"^(\d+\.(?:\d+\.)*)\s+(.+)", r"^([A-Z؀-ۿ][\w\s]{2,50}):?\s*$"),
}
NUMBERED_HEADING = r"^(\d+\.(?:\d+\.)*)\s+(.+)"
BLOCK_HEADERS = (
    rf"^[A-Z{ACCENTED_FR[len(ACCENTED_FR) // 2:]}؀-ۿ\s]+$",
    rf"^\d+\.\s+[A-Z{ACCENTED_FR[len(ACCENTED_FR) // 2:]}؀-ۿ]",
    r"^CHAPITRE\s+\d+",
    r"^الفصل\s+\d+",
)
BLOCK_FOOTERS = (r"^\d+$", r"^p\s+\d+", r"^ص\s+\d+", r"^\d{2}/\d{2}/\d{4}")
PARAGRAPH_HEADINGS = (
    r"^TITRE\s+[IVXLCDM]+", r"^CHAPITRE\s+\d+", r"^SECTION\s+\d+", r"^ARTICLE\s+\d+",
    r"^العنوان\s+\d+", r"^الفصل\s+\d+", r"^القسم\s+\d+", r"^المادة\s+\d+",
)

# --- fixed values: files, metrics, messages -----------------------------------------------------------------

UPLOAD_EXTENSIONS = "pdf docx doc txt png jpg jpeg gif".split()
FILE_EXTENSIONS = ".pdf .docx .doc .png .jpg .jpeg .bmp .tiff .tif".split()
MAX_FILE_BYTES = 100 * 1024 * 1024

#: metric: (threshold, level, message, format of the value)
ALERT_RULES = {
    "extraction_failure_rate": (0.10, "warning", "Taux d'échec d'extraction élevé: %s", "percent2"),
    "response_time_p95": (5.0, "warning", "Temps de réponse P95 élevé: %ss", "plain2"),
    "memory_usage": (0.85, "critical", "Utilisation mémoire critique: %s", "percent1"),
    "cpu_usage": (0.90, "warning", "Utilisation CPU élevée: %s", "percent1"),
    "disk_usage": (0.90, "critical", "Espace disque critique: %s", "percent1"),
}
COOLDOWN_SECONDS = 300
NO_SUMMARY = "Aucun contenu significatif trouvé."
TOO_SHORT = "Document trop court pour un résumé abstractif."
ABSTRACT = "Ce document de %s mots traite de sujets variés et contient des informations importantes."
CHAT_SORRY = "Je suis désolé, l'intégration IA n'est pas encore disponible. "
CHAT_SELECT = "Veuillez d'abord sélectionner un document."
