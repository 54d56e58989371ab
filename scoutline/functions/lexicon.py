"""Word lists, suffixes and tables that results depend on."""

SUFFIXES = "a e ı i u ü y ya ye yi yu yü da de ta te dan den tan ten la le yla yle ın in un ün nın nin nun nün sı si su sü lar ler larda lerde ların lerin ları leri ınav iniz imiz umuzu ümüzü ımızı imizi".split()
SHORT_SUFFIXES = "larında lerinde ndaki daki deki ları leri dan den tan ten nın nin da de ta te ya ye yi yı i ı u ü e a".split()

#: In order of priority.
CATEGORIES = {
    "hastane_saglik": ("hastane", "klinik", "sağlık ocağı", "tıp merkezi", "eczane", "poliklinik", "dispanser", "şifa", "acil", "ambulans"),
    "is_endustri": ("fabrika", "plato", "depo", "sanayi", "atölye", "şantiye", "ofis", "holding", "dükkan", "mağaza", "hangar", "tersane", "depolar", "atölyeler"),
    "park_doga": ("park", "bahçe", "koru", "arboretum", "botanik", "orman", "yayla", "mesire", "piknik", "vadi", "dağ", "tepe", "plato", "kamp", "kaya", "kayalık", "uçurum", "yamaç", "patika"),
    "gar_ulasim": ("gar", "istasyon", "viyadük", "köprü", "demiryol", "ray", "havalimanı", "havaalanı", "terminal", "otogar", "liman", "iskele", "rıhtım", "peron", "tünel", "otoban", "geçit", "raylar", "makas"),
    "sokak_kentsel": ("sokak", "cadde", "yol", "mahalle", "bulvar", "meydan", "arasta", "çarşı", "pazar", "geçit", "kaldırım", "ara sokak", "arnavut kaldırımı", "caddeler"),
    "konut_tarihi": ("konak", "köşk", "saray", "apartman", "apartıman", "villa", "ev", "rezidans", "yalı", "kale", "hisar", "şato", "kervansaray", "han", "tapınak", "manastır", "kilise", "cami", "türbe", "yalılar", "konaklar"),
    "su_kenari": ("deniz", "sahil", "kıyı", "kumsal", "plaj", "göl", "baraj", "şelale", "nehir", "çay", "dere", "azmak", "kanyon", "koy", "körfez", "delta", "marina", "liman", "rıhtım", "iskele"),
    "sosyal_eglence": ("kafe", "cafe", "restoran", "lokanta", "bar", "kulüp", "meyhane", "otel", "pansiyon", "sinema", "tiyatro", "müze", "kütüphane", "sahaf", "kıraathane", "pavyon", "kulübü", "lokantası"),
    "resmi_kurum": ("karakol", "emniyet", "adliye", "meclis", "valilik", "belediye", "okul", "üniversite", "kampüs", "askeriye", "kışla", "cezaevi", "hapishane", "nezarethane", "adliyesi", "okulu"),
    "koy_kirsal": ("köy", "tarla", "samanlık", "ahır", "traktör", "çiftlik", "mera", "koyun", "keçi", "toprak yol", "kerpiç", "bağ", "bahçe", "ekin"),
    "tarihi_antik": ("antik", "harabe", "kalıntı", "sütun", "tapınak", "manastır", "antik kent", "sit alanı", "kazı", "lahit", "tiyatro", "surlar", "kule"),
    "ibadethane_inanc": ("cami", "kilise", "tapınak", "manastır", "sinagog", "havra", "türbe", "mescit", "mihrap", "minare", "çan kulesi"),
    "spor_rekreasyon": ("stadyum", "saha", "kort", "havuz", "spor salonu", "pist", "hipodrom", "antrenman", "tribün"),
    "askeri_guvenlik": ("kışla", "askeri", "karargah", "nöbet kulübesi", "cezaevi", "hapishane", "nezarethane", "üs bölgesi", "radar", "tel örgüler"),
}
CATEGORY_LABELS = {
    "hastane_saglik": "Sağlık & Hastane", "is_endustri": "İş & Endüstri", "park_doga": "Doğa & Orman", "gar_ulasim": "Ulaşım & Liman",
    "sokak_kentsel": "Sokak & Kentsel", "konut_tarihi": "Tarihi & Konut", "su_kenari": "Sahil & Su Kenarı", "sosyal_eglence": "Sosyal & Eğlence",
    "resmi_kurum": "Resmi & Eğitim", "koy_kirsal": "Köy & Kırsal", "tarihi_antik": "Tarihi Harabe & Antik Sit", "ibadethane_inanc": "İbadethane & İnanç",
    "spor_rekreasyon": "Spor & Rekreasyon", "askeri_guvenlik": "Askeri & Güvenlik",
}
DEFAULT_LABEL = "Genel Dış Mekan"

#: Genre: categories that gain, categories that lose.
GENRE_ADJUSTMENTS = {
    "Polisiye": (("is_endustri", "sokak_kentsel", "resmi_kurum", "askeri_guvenlik"), ("su_kenari", "sosyal_eglence", "koy_kirsal")),
    "Aksiyon": (("is_endustri", "gar_ulasim", "sokak_kentsel", "askeri_guvenlik"), ("sosyal_eglence",)),
    "Romantik": (("su_kenari", "sosyal_eglence", "park_doga", "koy_kirsal"), ("is_endustri", "resmi_kurum", "askeri_guvenlik")),
    "Komedi": (("sokak_kentsel", "sosyal_eglence", "konut_tarihi"), ("askeri_guvenlik", "tarihi_antik")),
    "Dram": (("konut_tarihi", "sokak_kentsel", "park_doga", "koy_kirsal", "ibadethane_inanc"), ()),
    "Fantastik": (("tarihi_antik", "park_doga", "konut_tarihi", "ibadethane_inanc"), ("is_endustri", "resmi_kurum")),
}

#: Aliases and provinces, in order of priority.
REGIONS = (
    (("ege",), ("İzmir", "Muğla", "Aydın", "Denizli", "Manisa", "Afyonkarahisar", "Kütahya", "Uşak", "Balıkesir")),
    (("karadeniz",), ("Trabzon", "Rize", "Artvin", "Giresun", "Ordu", "Samsun", "Sinop", "Zonguldak", "Bolu", "Kastamonu", "Amasya", "Tokat", "Çorum", "Karabük", "Bartın", "Düzce", "Gümüşhane", "Bayburt")),
    (("akdeniz",), ("Antalya", "Mersin", "Adana", "Hatay", "Kahramanmaraş", "Osmaniye", "Isparta", "Burdur")),
    (("marmara",), ("İstanbul", "Bursa", "Kocaeli", "Balıkesir", "Çanakkale", "Edirne", "Tekirdağ", "Kırklareli", "Yalova", "Sakarya", "Bilecik")),
    (("güneydoğu", "guneydogu"), ("Mardin", "Gaziantep", "Şanlıurfa", "Diyarbakır", "Batman", "Siirt", "Şırnak", "Kilis", "Adıyaman")),
    (("doğu", "dogu"), ("Erzurum", "Van", "Malatya", "Elazığ", "Kars", "Ağrı", "Iğdır", "Ardahan", "Muş", "Bitlis", "Hakkari", "Bingöl", "Tunceli", "Erzincan")),
    (("anadolu", "orta anadolu", "iç anadolu", "ic anadolu"), ("Ankara", "Konya", "Kayseri", "Eskişehir", "Sivas", "Kırıkkale", "Kırşehir", "Yozgat", "Nevşehir", "Niğde", "Aksaray", "Karaman", "Çankırı")),
)

THEMES = {"tarihi": "tarih", "doğal": "doğa|vadi|mağara|yürüyüş", "kültürel": "kültür|sanat|müze", "gastronomi": "gastronomi|kafe|restoran|lezzet", "gece_hayati": "gece hayatı|bar|eğlence", "macera": "macera|balon|tekne|at binme"}
REGION_ALIASES = {"cappadocia": "Nevşehir", "kapadokya": "Nevşehir", "istanbul": "İstanbul", "izmir": "İzmir"}
STOP_WORDS = "ve ile bir bu da de için gibi çok daha olan olarak the a an in of to".split()

PLACE_TERMS = ("sokak", "cadde", "bulvar", "mahalle", "semt", "meydan", "çarşı", "pazar", "arasta", "köy", "kasaba", "şehir", "kent", "ilçe", "sanayi", "bölge", "bölgesi", "konak", "köşk", "villa", "yalı", "mansion", "apartman", "bina", "ev", "oda", "fabrika", "depo", "hangar", "ambar", "atölye", "tersane", "okul", "üniversite", "kampüs", "lise", "ilkokul", "hastane", "klinik", "acil", "sağlık", "karakol", "emniyet", "adliye", "mahkeme", "cezaevi", "nezarethane", "cami", "kilise", "manastır", "türbe", "mescit", "tapınak", "sahil", "plaj", "kıyı", "deniz", "göl", "nehir", "ırmak", "dere", "orman", "park", "bahçe", "mezarlık", "tarla", "çiftlik", "bağ", "dağ", "tepe", "vadi", "kanyon", "yayla", "mağara", "gar", "istasyon", "terminal", "köprü", "viyadük", "liman", "iskele", "rıhtım", "havalimanı", "havaliman", "havaalanı", "kale", "hisar", "burç", "sur", "kervansaray", "han", "hamam", "saray", "antik", "arkeolojik", "harabe", "kalıntı", "sütun", "tiyatro", "meydanı", "meydanda", "alanı", "semtinde", "sokağında", "caddesinde", "gece kulübü", "pavyon", "bar", "kafe", "restoran", "otel", "pansiyon")
TIME_TERMS = ("sabah", "öğle", "öğleden", "öğleden sonra", "akşam", "gece", "gece yarısı", "şafak", "gün doğumu", "gün batımı", "alacakaranlık", "tan", "ilkbahar", "bahar", "yaz", "sonbahar", "kış", "kışın", "yazın", "yıl", "yılında", "asır", "yüzyıl", "dönem", "devir", "çağ", "tarihinde", "ertesi", "önceki", "sonraki", "o gün", "o gece", "o sabah", "geçmişte", "eskiden", "bugün", "şimdilerde")
EVENT_TERMS = ("kovalamaca", "kovalama", "takip", "pusu", "çatışma", "kavga", "dövüş", "saldırı", "kaçış", "baskın", "operasyon", "arama", "tarama", "tutuklama", "gözaltı", "cinayet", "öldürme", "hırsızlık", "soygun", "kaçakçılık", "uyuşturucu", "şantaj", "dolandırıcılık", "sahtecilik", "düğün", "nikah", "nişan", "cenaze", "yas", "tören", "kutlama", "parti", "kavuşma", "ayrılık", "veda", "buluşma", "randevu", "ilk tanışma", "itiraf", "yüzleşme", "tartışma", "sorgu", "sorgulama", "keşif", "bulma", "gizem", "sır", "araştırma", "soruşturma")

GENRES = {
    "Dram": "Dram", "Drama": "Dram", "Aile Draması": "Dram", "Sosyal Dram": "Dram", "Psikolojik Dram": "Dram", "Komedi": "Komedi", "Romantik Komedi": "Romantik",
    "Komedi/Dram": "Dram", "Romantik": "Romantik", "Aşk": "Romantik", "Gerilim/Suç": "Polisiye", "Suç/Gerilim": "Polisiye", "Polisiye": "Polisiye",
    "Gerilim": "Polisiye", "Suç": "Polisiye", "Gizem": "Polisiye", "Aksiyon": "Aksiyon", "Macera": "Aksiyon", "Aksiyon/Macera": "Aksiyon", "Tarihi": "Tarihi",
    "Dönem Draması": "Tarihi", "Tarihi Dram": "Tarihi", "Tarihi/Dram": "Tarihi", "Fantastik": "Fantastik", "Bilim Kurgu": "Fantastik", "Korku": "Fantastik",
}
GENRE_CASCADE = (("polisiye|suç|gerilim", "Polisiye"), ("aksiyon|macera", "Aksiyon"), ("tarihi|dönem", "Tarihi"), ("romantik|aşk", "Romantik"), ("komedi", "Komedi"), ("dram", "Dram"), ("fantastik|bilim|korku", "Fantastik"))

#: The shorter category list that metadata filters use, in order of priority, and their regions.
REDUCED_CATEGORIES = {
    "park_doga": ("park", "bahçe", "orman", "yayla", "vadi", "dağ", "tepe"),
    "gar_ulasim": ("gar", "istasyon", "köprü", "liman", "iskele", "rıhtım"),
    "sokak_kentsel": ("sokak", "cadde", "mahalle", "meydan", "çarşı"),
    "konut_tarihi": ("konak", "köşk", "saray", "yalı", "kale", "han"),
    "is_endustri": ("fabrika", "depo", "sanayi", "atölye", "hangar"),
    "su_kenari": ("deniz", "sahil", "kıyı", "kumsal", "plaj", "göl", "nehir"),
    "sosyal_eglence": ("kafe", "restoran", "otel", "müze", "tiyatro"),
    "resmi_kurum": ("karakol", "adliye", "okul", "üniversite", "kışla"),
    "koy_kirsal": ("köy", "tarla", "çiftlik", "ahır", "mera"),
    "tarihi_antik": ("antik", "harabe", "kalıntı", "sit alanı", "surlar"),
    "ibadethane_inanc": ("cami", "kilise", "manastır", "türbe", "mescit"),
}
REDUCED_REGIONS = {
    "ege": ("izmir", "muğla", "aydın", "denizli", "manisa"),
    "karadeniz": ("trabzon", "rize", "artvin", "giresun", "ordu", "samsun"),
    "akdeniz": ("antalya", "mersin", "adana", "hatay", "isparta"),
    "marmara": ("istanbul", "bursa", "kocaeli", "çanakkale", "edirne"),
}
