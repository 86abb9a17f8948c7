"""Rule packs: patterns, vocabularies and weights that operators take as parameters.

The engine is domain-neutral. What follows is one pack, for radiotherapy physics reports;
any of it can be replaced by passing other values.
"""

from __future__ import annotations

# Kinds of questions, tested in this order.
QUERY_TYPES = {
    "section_locator": ("^which section", "^where does"),
    "definition": (r"^what is\b", r"^define\b", r"\baccording to\b"),
    "recommendation": (r"\brecommend", r"\bguidance", r"\bshould\b"),
    "comparison": (r"^compare\b", r"\bdifference\b", r"\bversus\b|\bvs\b"),
}

# Phrases that mark a definition.
DEFINITION_CUES = ("is referred to as", "is defined as", "refers to", "can be subdivided into")

# Therapy kinds that make a passage specific to one of them.
MODALITIES = ("brachytherapy", "electron therapy", "photon therapy", "proton therapy", "carbon ion therapy", "total body irradiation", "concomitant imaging doses")

# Sections of summaries.
SUMMARY_SECTIONS = ("8. RECOMMENDATIONS", "6. TECHNIQUES TO MINIMIZE NONTARGET DOSE")

# Phrases of summaries.
SUMMARY_PHRASES = ("this report provides", "this report aims to", "to those ends", "the focus of this report", "provides guidance")

# Report identifiers, applied to lower-cased text.
REPORT_CUES = {
    "tg": r"\b(?:tg|task\s*group)\s*[-#:]?\s*(\d+[a-z]?)\b",
    "report": r"\b(?:aapm\s*)?(?:report|rpt)\s*(?:no\.?|number|#)?\s*[-#:]?\s*(\d+[a-z]?)\b",
    "trs": r"\btrs\s*[-#:]?\s*(\d+[a-z]?)\b",
    "tecdoc": r"\btecdoc\s*[-#:]?\s*(\d+[a-z]?)\b",
    "hhr": r"\b(?:hhr|human\s+health\s+reports?\s*(?:no\.?|number)?)\s*[-#:]?\s*(\d+[a-z]?)\b",
    "hhs": r"\b(?:hhs|human\s+health\s+series\s*(?:no\.?|number)?)\s*[-#:]?\s*(\d+[a-z]?)\b",
    "ssg": r"\bssg\s*[-#:]?\s*(\d+[a-z]?)\b",
    "srs": r"\bsrs\s*[-#:]?\s*(\d+[a-z]?)\b",
    "pub": r"\bpub(?:lication)?\s*[-#:]?\s*(\d+[a-z]?)\b",
}

# Words that don't tell titles apart.
TITLE_STOPWORDS = (
    "aapm", "iaea", "report", "reports", "publication", "radiation", "radiotherapy", "therapy", "physics", "quality", "assurance", "guidance",
    "evidence", "grounded", "matter", "covers", "cover", "what", "which", "does", "that", "would", "for", "and", "the", "with",
)

# Words that carry no content in a question.
QUERY_STOPWORDS = (
    "a", "an", "and", "are", "as", "according", "about", "based", "be", "by", "define", "discuss", "discussed", "does", "for", "from", "how", "in",
    "is", "it", "of", "on", "or", "say", "section", "the", "to", "tg", "what", "which", "with",
)

# Questions about tables and figures.
ASSET_QUERY = r"(?i)\b(table|figure|fig\.?|diagram|asset)\b|\b(?:detected|displayed|shown|this|that|the)\s+image\b|\bimage\s+(?:asset|metadata|above|below|shown|displayed|on\s+page)\b"

# Questions that ask for a list.
LISTING_QUERY = r"(?i)\b(?:what|which|list|name|identify|describe)\b.*\b(?:actions?|areas?|categories|elements|indices|issues|methods|purposes|properties|reasons|systems|technologies|tests|tools|types)\b"

# Tags and the patterns that set them.
TAGS = {
    "measurement": (r"\bdosimetr(?:y|ic)\b", r"\bdetector(?:s)?\b", r"\bmeasurement(?:s)?\b", r"\bphantom(?:s)?\b"),
    "computation": (r"\bmonte carlo\b", r"\btreatment planning\b", r"\banalytical model\b", r"\bcalculation(?:s)?\b", r"\bcomputational\b"),
    "dose_reporting": (r"\bdose reporting\b", r"\bequivalent dose\b", r"\borgan doses?\b", r"\beffective dose\b", r"\breport(?:ing)?\b"),
    "risk": (r"\bsecond(?:ary)? cancer\b", r"\bcardiac toxicity\b", r"\bfetal dose\b", r"\bcataract\b", r"\bpacemaker\b", r"\blate effects?\b", r"\brisk\b"),
    "modality_specific": tuple(rf"\b{m}\b" for m in MODALITIES),
}

# Wording that sets the recommendation tag.
RECOMMENDATION = r"\brecommend(?:ation|ations|ed)?\b"

# Kinds of scenes for routing.
QUESTION_PATTERNS = {
    "definition": r"\b(define|what is|what are|meaning of|stands for)\b",
    "comparison": r"\b(compare|difference|differentiate|versus|vs\.?|contrast)\b",
    "procedure": r"\b(how should|procedure|workflow|steps|commission|acceptance|qa program|programme)\b",
    "calculation": r"\b(calculate|derive|formula|equation|constant|half-life|output factor|monitor unit|mu)\b",
    "table_or_figure": r"\b(table|figure|chart|diagram|image|appendix)\b",
}

# Domains and the terms that tag a question with them.
DOMAIN_TERMS = {
    "dosimetry": ("dosimetry", "dose", "absorbed", "calibration", "ionization", "chamber", "output factor", "small field", "brachytherapy", "reference dosimeter"),
    "quality_management": ("quality", "qa", "qc", "fmea", "risk", "audit", "chart review", "process map", "failure mode", "tolerance", "safety"),
    "imaging_guidance": ("igrt", "image", "imaging", "ct", "cbct", "registration", "localization", "surface guided", "setup", "fusion"),
    "treatment_planning": ("treatment planning", "tps", "commissioning", "beam model", "imrt", "vmat", "dose calculation", "monitor unit", "plan review"),
    "equipment": ("linac", "accelerator", "equipment", "machine", "record and verify", "mlc", "epid", "tomotherapy"),
    "facility_safety": ("facility", "shielding", "room", "radiation protection", "staffing", "programme", "infrastructure"),
}

# Words and phrases of other domains.
OUT_OF_DOMAIN = (
    "bread", "crypto", "municipal", "portfolio", "dental", "antibiotic", "stock", "recipe", "weather", "legal", "tax", "sourdough", "python",
    "web framework", "finance", "dashboard", "filing", "proprietorship", "california", "violin", "violinist", "baroque", "ornamentation", "soil",
    "blueberries", "garden", "chess", "opening", "kitchen", "faucet", "cartridge", "kyoto", "itinerary", "marathon", "knee injury", "camera", "lens",
    "photography", "mortgage", "refinance", "mold", "bathroom", "grout", "jazz", "piano", "voicings", "wi-fi", "wifi", "packet loss", "home network",
    "flour", "neapolitan", "pizza", "dough",
)

# Questions about a patient or another speciality, which stay unanswered.
BOUNDARIES = (
    r"\b(chemotherapy|immunotherapy|antibiotic|cellulitis|radiation dermatitis)\b",
    r"\b(surgery|surgical|survival benefit|cure rate|prognosis)\b",
    r"\b(icd-?10|billing|insurance|authorization|malpractice|legal requirement)\b",
    r"\b(mri protocol|pet/ct suv|contrast dose|renal insufficiency)\b",
    r"\b(suv cutoff|standardized uptake value|malignant recurrence|diagnose recurrence)\b",
    r"\b(diet|nutrition|skin burns?|osteoradionecrosis|dental management)\b",
    r"\b(nausea|vomiting|pain control|symptom management|side effect management)\b",
    r"\b(insulin|hypoglycemia|hypoglycaemia|medication management|drug regimen|dose adjustment)\b",
    r"\b(mri sequence|ischemic stroke|ischaemic stroke|emergency department)\b",
    r"\b(should i|should my|my mother|my father|my wife|my husband|this patient)\b",
    r"\b(which treatment should|choose sbrt or surgery|treatment regimen)\b",
)

# Words of a question that spans reports.
BROAD = r"\b(across|between|multiple|several|overall)\b"

# Strategies by kind of task (name, backend, evidence rows).
STRATEGIES = {
    "out_of_scope": ("ood_sparse_probe", "sparse", 3),
    "scoped": ("scoped_sparse", "sparse", 6),
    "definition": ("definition_sparse_microchunk", "sparse", 5),
    "asset_lookup": ("asset_aware_sparse", "sparse", 8),
    "procedure_or_qa": ("qa_sparse_exact_terms", "sparse", 8),
    "synthesis_dense": ("hybrid_rrf_synthesis", "hybrid", 8),
    "synthesis_sparse": ("broad_sparse_synthesis", "sparse", 8),
    "calculation_or_formula": ("formula_sparse", "sparse", 6),
    "direct_fact": ("sparse_direct", "sparse", 5),
}

# Sections that establish identity but answer nothing.
WEAK_SECTIONS = ("FRONT_MATTER", "REFERENCES", "ACKNOWLEDGMENTS", "ACKNOWLEDGEMENTS")

# Wording that claims more than evidence gives.
OVERCLAIMS = (
    r"\b(?:this patient|you|your doctor)\s+should\b",
    r"\b(?:i|we)\s+(?:recommend|prescribe|diagnose)\b",
    r"\b(?:this patient|you)\s+(?:must|need to|require)\b",
    r"\b(?:clinical recommendation|medical advice|treatment decision)\s+(?:is|would be)\b",
)

# Weights of the reranker's model score, prior and bonus by kind of question.
BLEND_WEIGHTS = {"definition": (0.55, 0.45, 0.15), "section_locator": (0.58, 0.42, 0.20), "recommendation": (0.62, 0.38, 0.20)}

# The weights of other questions.
BLEND_DEFAULT = (0.65, 0.35, 0.25)

# Topics and the keywords that assign chunks to them.
TAXONOMY = {
    "reference-dosimetry": ("dosimetry", "absorbed dose", "calibration", "ionization", "chamber", "beam quality", "reference dosimeter", "small field", "trs 398", "trs 469", "tg-51", "output factor"),
    "brachytherapy": ("brachytherapy", "source calibration", "hdr", "ldr", "ocular", "plaque", "mesh", "photon and beta"),
    "treatment-planning": ("treatment planning", "tps", "commissioning", "acceptance", "beam model", "dose calculation", "monitor unit", "mu", "imrt", "vmat", "plan review", "record and verify"),
    "imaging-and-localization": ("imaging", "igrt", "ct", "cbct", "registration", "fusion", "localization", "setup", "surface guided", "image guidance"),
    "quality-management-and-safety": ("quality", "qa", "qc", "audit", "quatro", "fmea", "risk", "safety", "chart review", "failure mode", "process map"),
    "equipment-and-facilities": ("linac", "accelerator", "equipment", "facility", "shielding", "staffing", "programme", "infrastructure", "room"),
    "nomenclature-and-data": ("nomenclature", "structure", "naming", "data transfer", "interoperability", "electronic chart", "tg263"),
    "biological-models-and-response": ("tcp", "ntcp", "biological", "biologically", "radiobiology", "rbe", "response model", "biophysical", "model qa", "optimization"),
    "nontarget-dose-and-radiation-protection": ("nontarget", "out-of-field", "radiation protection", "induced", "safety of sources", "shielding", "imaging dose"),
    "education-and-foundations": ("handbook", "training", "resident", "education", "fundamentals", "half-life", "radioactive decay"),
}

# The topic of chunks that no keyword assigns.
FALLBACK_TOPIC = "education-and-foundations"

# Words left out of a topic's frequent terms.
TOPIC_TERM_STOPWORDS = ("the", "and", "for", "with", "report", "radiotherapy", "radiation")
