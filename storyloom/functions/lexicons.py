"""Word lists, lookup tables and thresholds that results depend on."""

RELATIONSHIP_WORDS = {
    "어머니": "family_parent", "아버지": "family_parent", "부모": "family_parent", "아들": "family_parent", "딸": "family_parent", "자녀": "family_parent",
    "형": "family_sibling", "누나": "family_sibling", "오빠": "family_sibling", "언니": "family_sibling", "남매": "family_sibling", "형제": "family_sibling", "자매": "family_sibling", "쌍둥이": "family_sibling",
    "남편": "family_spouse", "아내": "family_spouse", "배우자": "family_spouse", "연인": "romantic", "애인": "romantic", "친구": "friend", "절친": "friend",
    "동료": "colleague", "동기": "colleague", "파트너": "colleague", "라이벌": "rival", "경쟁자": "rival", "적": "enemy", "원수": "enemy", "숙적": "enemy",
    "스승": "mentor_student", "제자": "mentor_student", "사제": "mentor_student", "주인": "master_servant", "하인": "master_servant", "종복": "master_servant",
}
RELATIONSHIP_TYPES = ["family_parent", "family_sibling", "family_spouse", "family_other", "romantic", "friend", "colleague", "rival", "enemy", "master_servant", "mentor_student", "organization"]
EMOTIONS = ["love", "hate", "trust", "distrust", "fear", "jealousy", "gratitude", "resentment", "admiration", "contempt", "neutral"]
OPPOSITE_EMOTIONS = [("love", "hate"), ("trust", "distrust"), ("admiration", "contempt"), ("gratitude", "resentment")]
CONFLICTS = [
    ("family_parent", "family_sibling", "critical"),
    ("family_parent", "family_spouse", "critical"),
    ("family_sibling", "family_spouse", "warning"),
    ("family_parent", "romantic", "warning"),
    ("colleague", "enemy", "warning"),
    ("friend", "enemy", "critical"),
    ("mentor_student", "enemy", "warning"),
    ("romantic", "enemy", "warning"),
]
MULTI_VALUE_TRAITS = ["성격", "특기", "취미", "능력", "장점", "단점", "기술", "특성"]
PROHIBITIVE = ["혐오", "절대", "하지 않", "않는다", "못하", "안 마", "마시지 않", "먹지 않", "싫어", "거부", "금지", "불가", "불능", "봉인", "할 수 없", "사용할 수 없", "수 없는", "참여하지 않", "일절", "극혐", "입에 대지", "안 하", "안 함", "대지 않"]
PARTICLES = ["에서", "에게", "로서", "하며", "이며", "이고", "까지", "부터", "를", "을", "가", "이", "은", "는", "에", "로", "의", "도", "만", "와", "과", "며", "고"]
CONTENT_STOP = ["하지", "않는", "못하", "않고", "않다", "않는다", "절대", "혐오", "마시지", "먹지", "싫어", "거부", "한다", "하며", "이며", "최소", "이후", "이상", "이하", "미만", "이내", "초과", "부터", "까지", "차로", "걸어", "소요", "걸림"]
LOCKOUT = "봉쇄|차단|폐쇄|통제|출입금지|진입불가|제한|잠금|락다운|lockdown|봉인"
MOVEMENT = "이동|소요|거리|경로|도착|출발|왕복|편도|걸어|차로|도보|운전|비행|항해|구간|노선|통로|접근|진입|탈출|횡단|통과|수송|운반|운송|배달"
NON_MOVEMENT = "약물|약효|투여|진정제|마취|기억|의식|사망|치료|효과|회복|발현|독|해독|감염|잠복|발작|수술|치유|중독|복용|증상|판정|부작용|충전|냉각|재시동|부팅|워밍업|준비|세팅|셋업|작동|가동"
NEGATIONS = ["아니다", "아닌", "없다", "없음", "아니", "못", "않", "not", "never", "no"]
NEGATION_PREFIXES = ["아니", "않", "못", "없", "not"]
TOKEN_SUFFIXES = ["입니다", "이었다", "였다", "이다", "다", "은", "는", "이", "가", "을", "를", "의", "와", "과"]
SEMANTIC_STOP = ["은", "는", "이", "가", "을", "를", "의", "에", "과", "와", "and", "or", "the", "a", "an", "is", "are", "was", "were"]
REPORT_ENDINGS = [
    "에서|까지는|까지|으로는|에서의|이라|으로|에게|한테|하며|하는데|했다고|되어|있어|가능|통해서만|통해|걸려야|만에|하는|인데|있는|했다|된다|한다|이다|하여|대로|이지만|라는|라고|에는|으며|이며|에도|지만|이나",
    "을|를|이|가|은|는|의|에|로|과|와|도|서|만|씩|들|째",
]
#: Patterns of chapter and scene headings, tried in this order.
CHAPTER_PATTERNS = [r"#\s*Scene\s*\d+", r"Scene\s*\d+", r"S#\d+", r"#\s*Chapter\s*\d+", r"제\s*\d+\s*[장|화]", r"EP\d+"]
SECTIONS = {"[세계관]": "worldview", "[설정집]": "settings", "[시나리오]": "scenario"}
#: Fixed values of gold annotation: patterns of each category, in this order; what none finds is TRAIT_SETTING.
GOLD_CATEGORIES = [
    ("DEATH_REAPPEAR", ["사망", "시체", "재등장", "사망 후", "죽은", "사망 판정", "처형", "사망자", "부활", "죽었", "사망했", "눈을 뜬", "의식을 잃"]),
    ("TIMELINE_MOVE", ["이동 시간", "분 소요", "분 만에", "분 규칙", "분 이동", "도보", "소요 시간", "분이 걸", "분이면", "분 거리", "\\d+분", "위치가 바뀌", "장소가 바뀌", "장소가 다", "위치가 다", "에 있는데.*에 있", "도쿄.*방콕", "방콕.*도쿄", "에펠탑", "지리적", "출발.*도착", "도착.*출발"]),
    ("INFO_ASYMMETRY", ["정보 비대칭", "알고 있", "전에 알", "먼저 알", "인지 전", "정보를 알", "이미 알", "알 수 없", "몰랐", "모르는데", "확인 전에", "발견 전에", "전에.*사실을", "전부터.*알", "어떻게 알", "듣기 전"]),
    ("SECURITY_ITEM", ["열쇠", "카드", "마스터키", "토큰", "유일", "단 하나", "복제", "양도 불가", "소유.*위반", "보안 카드", "인증.*키", "하나뿐", "하나인데.*둘", "동시에 가지"]),
    ("PHYSICS_RULE", [
        "봉쇄", "금지", "잠금", "잠긴", "통제", "블랙아웃", "통신 차단", "봉인", "규칙 위반", "법칙", "물리적", "우주복", "장비 없이", "마법 봉인", "불가능", "조약", "전면 금지",
        "날씨", "비가.*맑", "맑.*비가", "눈이.*비", "비.*눈이", "하늘.*비", "노을.*비", "폭우.*맑", "맑.*폭우", "보름달.*그믐", "그믐.*보름달", "달빛.*그믐", "달이 없.*달빛", "별.*보이지 않.*별빛", "별빛.*별.*보이지",
        "벚꽃.*12월", "12월.*벚꽃", "겨울.*벚꽃", "벚꽃.*겨울", "패딩.*반팔", "반팔.*패딩", "산.*바다", "바다.*산", "민물.*바다", "바다.*민물", "해수.*민물", "민물.*해수", "산장.*파도", "파도.*산장",
        "통신.*차단.*통화", "통화.*차단", "네트워크.*없.*접속", "신호.*없.*통화", "장비.*없이.*외부", "마법.*사용할 수 없", "마법이 봉인.*마법을 사용", "불가.*했지만.*한다", "금지.*했지만",
    ]),
    ("OTHER", ["관계.*모순", "어머니.*남매", "남매.*어머니", "형제.*부모", "부모.*형제", "배우자.*형제", "동료.*적", "적.*동료", "가족 관계", "관계가 바뀌", "관계.*동시"]),
]
GOLD_DEFAULT = "TRAIT_SETTING"
GOLD_HARD = ["사망", "시체", "재등장", "죽은", "부활", "사망 후", "죽었", "관계.*동시", "어머니.*남매", "남매.*어머니", "형제.*부모.*동시", "부모.*형제.*동시"]
GOLD_UNITS = ["분", "시", "살", "년", "명", "개", "번"]
GOLD_WORDS = ["사망", "시체", "재등장", "봉쇄", "잠금", "열쇠", "카드", "마스터키", "우주복", "커피", "혐오", "마시", "습관", "설정", "견종", "고양이", "날씨", "비", "맑은", "노을", "보름달", "그믐", "의족", "입양", "펫샵", "유기견", "결혼", "혼자", "아내", "텔레포트", "순간이동", "마법", "봉인", "통신", "블랙아웃", "삼점슛", "레이업", "MVP", "승리", "패배"]
GOLD_STOP_NAMES = ["이것", "그것", "저것", "여기", "거기"]
