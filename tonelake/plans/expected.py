"""What the SQL beside the queries looks for: patterns written out, apart from those that the operators build. Fixed values."""

WORD = r"[^ \t\n\x0B\f\r\x1c-\x1f\x{85}\p{Z}]+"
HEDGING = r"(?i)approximately|may|could|might|subject to|uncertain|uncertainty|challenging|potential|expect|believe|anticipate|assume|estimate|if|should|would|possibly|likely|unlikely"
VAGUE = r"(?i)\b(?:some|many|various|certain|several|numerous|significant(?:ly)?|substantial(?:ly)?|approximate(?:ly)?|broad(?:ly)?|general(?:ly)?|roughly|around|about|near(?:ly)?|potentially|possibly)\b"
POSITIVE = r"(?i)\b(?:record|strong|growth|beat|exceeded|outperform|robust|solid|momentum|accelerat|expand|gain|improvement|confident|pleased|increased|grew|higher|above|ahead|positive|success|win|delight|launch(?:ed)?|innovat|compell)\b"
NEGATIVE = r"(?i)\b(?:decline|decreased|fell|miss(?:ed)?|below|lower|challeng|difficult|headwind|pressure|weak(?:ness)?|concern|risk|uncertain|impact(?:ed)?|disappoint|slowdown|contraction|loss|impairment|restructur|layoff|reduction)\b"
KEYWORDS = r"(?i)\b(?:expect|guidance|outlook|forecast|anticipate|project|target|full.year|fiscal \d{4}|next quarter)\b"
GUIDANCE = r"(?i)\b(?:expect(?:ation)?s?|guidance|outlook|forecast|project(?:ion)?|anticipate|target|full.year|fiscal \d{4}|next quarter|going forward|we believe\s+(?:revenue|earnings|growth)|will be approximately)\b"
RISK = r"(?i)\b(?:risk\s+factor|uncertain(?:ty)?|material(?:ly)?|adverse(?:ly)?|could\s+(?:harm|impair|negatively)|subject\s+to|no\s+assurance|litigation|regulatory\s+(?:risk|change)|competition\s+may)\b"
HIGHLIGHT = r"(?i)\b(?:revenue\s+(?:of|increased|decreased|grew)|net\s+income|earnings\s+per\s+share|gross\s+margin|operating\s+(?:income|cash\s+flow)|EBITDA|EPS\s+(?:of|was|were))\b"
FINANCIAL_NUMBER = r"(?i)\$\s*[\d,]+(?:\.\d+)?(?:\s*[BbMmKk](?:illion|illions?)?)?|\b\d{1,3}(?:,\d{3})+(?:\.\d+)?|\b\d+(?:\.\d+)?\s*%|\b\d+(?:\.\d+)?\s*x\b"
SPECIFIC_NUMBER = r"(?i)\$\s*[\d,]+(?:\.\d+)?(?:\s*[BbMmKk](?:illion)?)?|\b\d+(?:\.\d+)?\s*%|\b\d+(?:\.\d+)?\s*x\b"
ANY_NUMBER = r"(?i)[$£€¥]?[-−]?\d{1,3}(?:[,.\d]*\d)?(?:\s*(?:billion|million|trillion|thousand|B|M|T|K))?(?:\s*%)?"
QUARTER = r"""CASE WHEN regexp_matches({c}, '(?i)\b(?:Q1|first\s+quarter|three\s+months\s+ended\s+(?:march|jun))\b') THEN 'Q1' WHEN regexp_matches({c}, '(?i)\b(?:Q2|second\s+quarter|six\s+months\s+ended\s+(?:jun))\b') THEN 'Q2'
  WHEN regexp_matches({c}, '(?i)\b(?:Q3|third\s+quarter|nine\s+months\s+ended\s+(?:sep))\b') THEN 'Q3' WHEN regexp_matches({c}, '(?i)\b(?:Q4|fourth\s+quarter|twelve\s+months\s+ended|full.year|annual)\b') THEN 'Q4' END"""
ROLE = r"""CASE WHEN regexp_matches({c}, '(?i)\b(?:CEO|Chief Executive)\b') THEN 'CEO' WHEN regexp_matches({c}, '(?i)\b(?:CFO|Chief Financial)\b') THEN 'CFO' WHEN regexp_matches({c}, '(?i)\b(?:COO|Chief Operating)\b') THEN 'COO'
  WHEN regexp_matches({c}, '(?i)\b(?:Analyst|Research)\b') THEN 'Analyst' WHEN regexp_matches({c}, '(?i)\bOperator\b') THEN 'Operator' WHEN regexp_matches({c}, '(?i)\b(?:Investor Relations|IR)\b') THEN 'IR' ELSE 'unknown' END"""
ARTICLE_ROLE = r"""CASE WHEN {c} = '' THEN 'Executive' WHEN regexp_matches({c}, '(?i)\b(ceo|chief executive|president|co-ceo|co-chief)\b') THEN 'CEO' WHEN regexp_matches({c}, '(?i)\b(cfo|chief financial|finance officer)\b') THEN 'CFO'
  WHEN regexp_matches({c}, '(?i)\b(analyst|research|securities|capital|bank|asset|investment|equity)\b') THEN 'Analyst' WHEN contains(lower({c}), 'operator') THEN 'Operator' ELSE substring({c}, 1, 50) END"""
REPORT_PHRASES = r"(?is)this\s+(?:annual|quarterly)\s+report\s+(?:on\s+form\s+)?10-[kq]|forward[\s-]looking\s+statements?|safe\s+harbor\s+statement|cautionary\s+note\s+regarding|item\s+\d+[a-z]?\s*\.|table\s+of\s+contents|signature[s]?\s+pursuant\s+to\s+the\s+requirements"
RATED_UP = "upgrade|initiated|raised|buy|outperform|overweight"
RATED_DOWN = "downgrade|lowered|sell|underperform|underweight"


def count_of(pattern: str, column: str = "text") -> str:
    return f"len(regexp_extract_all({column}, '{pattern}'))"
