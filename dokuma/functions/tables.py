"""Lookup tables of the morphology: word lists as plain text, suffixes by rule.

Words lists that a deployment has of its own (a dictionary, names, domain terms) are
parameters of ``dokuma.functions.lexicon.Lexicon``; those below are its defaults.
"""

from __future__ import annotations

# Fixed values, needed as they are for right results.
ACRONYMS = dict(
    line.split("=", 1)
    for line in """
NATO=Kuzey Atlantik Antlaşması Örgütü
UN=Birleşmiş Milletler
UNESCO=BM Eğitim, Bilim ve Kültür Örgütü
UNICEF=BM Çocuklara Yardım Fonu
WHO=Dünya Sağlık Örgütü
IMF=Uluslararası Para Fonu
WTO=Dünya Ticaret Örgütü
EU=Avrupa Birliği
INTERPOL=Uluslararası Kriminal Polis Örgütü
FIFA=Uluslararası Futbol Federasyonları Birliği
IOC=Uluslararası Olimpiyat Komitesi
UEFA=Avrupa Futbol Birliği
TBMM=Türkiye Büyük Millet Meclisi
MEB=Milli Eğitim Bakanlığı
TDK=Türk Dil Kurumu
TTK=Türk Tarih Kurumu
TCMB=Türkiye Cumhuriyet Merkez Bankası
BDDK=Bankacılık Düzenleme ve Denetleme Kurumu
SPK=Sermaye Piyasası Kurulu
SGK=Sosyal Güvenlik Kurumu
KDV=Katma Değer Vergisi
ÖTV=Özel Tüketim Vergisi
ÖSYM=Ölçme, Seçme ve Yerleştirme Merkezi
YÖK=Yükseköğretim Kurulu
TÜİK=Türkiye İstatistik Kurumu
TÜBİTAK=Türkiye Bilimsel ve Teknolojik Araştırma Kurumu
ASELSAN=Askeri Elektronik Sanayii
ODTÜ=Orta Doğu Teknik Üniversitesi
İTÜ=İstanbul Teknik Üniversitesi
METU=Middle East Technical University
BOUN=Boğaziçi Üniversitesi
İÜ=İstanbul Üniversitesi
AU=Ankara Üniversitesi
BİLKENT=İhsan Doğramacı Bilkent Üniversitesi
TUS=Tıpta Uzmanlık Sınavı
DUS=Diş Hekimliğinde Uzmanlık Sınavı
YDUS=Yabancı Dil Uzmanlık Sınavı
KPSS=Kamu Personeli Seçme Sınavı
CMV=Sitomegalovirüs
EBV=Epstein-Barr Virüsü
VZV=Varisella-Zoster Virüsü
HHV=İnsan Herpes Virüsü
HSV=Herpes Simplex Virüsü
HIV=İnsan İmmün Yetmezlik Virüsü
HBV=Hepatit B Virüsü
HCV=Hepatit C Virüsü
RSV=Respiratuar Sinsisyal Virüs
HPV=İnsan Papilloma Virüsü
HAV=Hepatit A Virüsü
SLE=Sistemik Lupus Eritematozus
COPD=Kronik Obstrüktif Akciğer Hastalığı
DM=Diabetes Mellitus
HTN=Hipertansiyon
MI=Miyokard İnfarktüsü
DVT=Derin Ven Trombozu
PE=Pulmoner Emboli
AML=Akut Myeloid Lösemi
CML=Kronik Myeloid Lösemi
ALL=Akut Lenfoblastik Lösemi
CLL=Kronik Lenfositik Lösemi
ECG=Elektrokardiyogram
EEG=Elektroensefalogram
MRI=Manyetik Rezonans Görüntüleme
CT=Bilgisayarlı Tomografi
USG=Ultrasonografi
CBC=Tam Kan Sayımı
INR=Uluslararası Normalleştirilmiş Oran
LDL=Düşük Yoğunluklu Lipoprotein
HDL=Yüksek Yoğunluklu Lipoprotein
SMMM=Serbest Muhasebeci Mali Müşavir
YMM=Yeminli Mali Müşavir
SM=Serbest Muhasebeci
AI=Yapay Zeka
ML=Makine Öğrenmesi
LLM=Büyük Dil Modeli
NLP=Doğal Dil İşleme
API=Uygulama Programlama Arayüzü
CPU=Merkezi İşlem Birimi
GPU=Grafik İşlem Birimi
RAM=Rastgele Erişim Belleği
SQL=Yapılandırılmış Sorgu Dili
HTML=HiperMetin İşaretleme Dili
CSS=Basamaklı Stil Sayfaları
OS=İşletim Sistemi
BERT=Çift Yönlü Kodlayıcı Temsiller
GPT=Üretici Önceden Eğitilmiş Dönüştürücü
OPEC=Petrol İhraç Eden Ülkeler Örgütü
NAFTA=Kuzey Amerika Serbest Ticaret Anlaşması
NBA=Ulusal Basketbol Birliği
NFL=Ulusal Futbol Ligi
""".strip().splitlines()
)

# Fixed values.
MEDICAL = """
glomerül glomerülonefrit nefron nefropati hepatosit hepatit eritrosit lökosit trombosit nötrofil eozinofil bazofil lenfosit monosit makrofaj antijen
antikor sitokin reseptör ligand enzim substrat inhibitör agonist antagonist nöron sinaps akson dendrit miyelin nekroz apoptoz fibrozis skleroz stenoz
embolizm tromboz iskemi hipoksi asidoz alkaloz sepsis edema enflamasyon granülom metaplazi displazi neoplazi karsinoma sarkom lenfoma lösemi melanom
adenom polip kist abse fistül perforasyon obstrüksiyon invajinasyon intususepsiyon atelektazi pnömotoraks hidrotoraks plevral bakteri virüs parazit
mantar protozoa helmint endotoksin ekzotoksin antibiyotik antiviral antifungal streptokokus stafilokokus escherichia klebsiella pseudomonas salmonella
shigella mycobacterium helicobacter candida aspergillus plasmodium toxoplasma influenza rotavirus adenovirus coronavirus farmakokinetik farmakodinami
biyoyararlanım metabolit toksisite plazma serum doz morfin kodein aspirin paracetamol ibuprofen warfarin heparin insülin kortizol kortikosteroid
betabloker diüretik statin metformin semptom bulgu tanı tedavi prognoz komplikasyon kontrendikasyon endikasyon biyopsi aspirasyon transplantasyon
transplant diyaliz kemoterapi radyoterapi immunoterapi laparoskopi endoskopi kolonoskopi bronkoskopi kateter stent bypass anastomoz kardiyak pulmoner
hepatik renal serebral vasküler endokrin immün konjenital herediter otoimmün idiyopatik akut kronik primer sekonder malign benign solid kistik bilateral
unilateral sistemik lokal diffüz fokal infeksiyon enfeksiyon subakut subklinik progesteron prolaktin prostaglandin disfaji disfonksiyon hemoglobin
hematokrit kreatinin üre glukoz kolesterol trigliserit albumin bilirubin transaminaz amilaz lipaz troponin kreatinkinaz prokalsitonin
""".split()
# Fixed values.
SPORTS = "lig kulüp şampiyon turnuva kupa finalist semifinal stadyum transfer bonservis futbolcu kaleci forvet defans offside penaltı frikik korner".split()
# Fixed values.
TOURISM = """otel hostel resort transfer rezervasyon bagaj terminal destinasyon tur turist turizm rehber konaklama kapasite sezon charter paket voucher menü
restoran spa havuz suit standart delüks""".split()
# Fixed values.
PROPER_NOUNS = """
adana adıyaman afyonkarahisar ağrı aksaray amasya ankara antalya ardahan artvin aydın balıkesir bartın batman bayburt bilecik bingöl bitlis bolu burdur
bursa çanakkale çankırı çorum denizli diyarbakır düzce edirne elazığ erzincan erzurum eskişehir gaziantep giresun gümüşhane hakkari hatay ığdır ısparta
istanbul izmir kahramanmaraş karabük karaman kars kastamonu kayseri kırıkkale kırklareli kırşehir kilis kocaeli konya kütahya malatya manisa mardin
mersin muğla muş nevşehir niğde ordu osmaniye rize sakarya samsun siirt sinop sivas şanlıurfa şırnak tekirdağ tokat trabzon tunceli uşak van yalova
yozgat zonguldak anadolu trakya karadeniz ege marmara akdeniz doğu batı
""".split()
# Fixed values.
COMPOUNDS = {
    line.split("=")[0]: line.split("=")[1].split("+")
    for line in """
başbakan=baş+bakan
cumhurbaşkanı=cumhur+başkan
dışişleri=dış+iş
içişleri=iç+iş
maliye=mal+iye
belediye=beled+iye
ayakkabı=ayak+kap
yelkovan=yel+kovan
saatlik=saat+lik
günlük=gün+lük
yıllık=yıl+lık
aylık=ay+lık
haftalık=hafta+lık
gastrointestinal=gastro+intestinal
kardiyovasküler=kardio+vasküler
nöropsikiyatri=nöro+psikiyatri
biyokimya=biyo+kimya
mikrobiyoloji=mikro+biyoloji
farmakoloji=farma+koloji
patoloji=pato+loji
hematoloji=hemato+loji
nefroloji=nefro+loji
kardiyoloji=kardio+loji
radyoloji=radyo+loji
onkoloji=onko+loji
elektromanyetik=elektro+manyetik
termodinamik=termo+dinamik
hidroelektrik=hidro+elektrik
biyoinformatik=biyo+informatik
nanoteknoloji=nano+teknoloji
futbolcu=futbol+cu
basketbolcu=basketbol+cu
voleybolcu=voleybol+cu
""".split()
}
# Fixed values.
INTACT = "nasıl neden niçin belki dünya toplantı diye niye nice yeni beri geri dolu yani araba cuma dedi yedi".split()
# Fixed values.
MONTHS = """ocak şubat mart nisan mayıs haziran temmuz ağustos eylül ekim kasım aralık
january february march april may june july august september october november december""".split()
# Fixed values.
UNITS = "km m cm mm nm kg g mg ton sn dk sa ms tl usd eur gbp kb mb gb tb pb ml mcg meq iu mmhg mosm hz mhz ghz watt kw mw kcal cal".split()
# Fixed values.
ROMAN = "i ii iii iv vi vii viii ix xi xii xiii xiv xv xvi xvii xviii xix xx".split()


def harmonise(pattern: str) -> list[str]:
    """The surface forms of a suffix under vowel harmony. A stands for a or e by the backness of the
    stem; I for ı, i, u or ü by backness and rounding, but after an A, which is not round, for ı or i."""
    forms = []
    for low, high, plain in (("a", "ı", "ı"), ("a", "u", "ı"), ("e", "i", "i"), ("e", "ü", "i")):
        form, unround = "", False
        for c in pattern:
            form += low if c == "A" else (plain if unround else high) if c == "I" else c
            unround = unround or c == "A"
        if form not in forms:
            forms.append(form)
    return forms


def by_rule(rules: str) -> dict[str, str]:
    """surface -> label of lines 'label pattern pattern ...'."""
    return {form: label for label, *patterns in (line.split() for line in rules.strip().splitlines()) for pattern in patterns for form in harmonise(pattern)}


def as_listed(lines: str) -> dict[str, str]:
    """surface -> label of lines 'label surface surface ...'."""
    return {form: label for label, *forms in (line.split() for line in lines.strip().splitlines()) for form in forms}


#: Suffixes with their labels: case, number and possession, person, tense and mood, voice, derivation.
SUFFIXES = by_rule("""
-ACC I yI
-DAT A yA
-LOC dA tA
-ABL dAn tAn
-GEN In nIn
-INS lA
-EQU cA çA
-REL+LOC dAki tAki ndAki
-PL lAr
-PL+EQU lArcA
-P3 sI
-P1PL ImIz
-P2PL InIz
-1SG m Im
-2SG n sIn
-1PL k Iz
-2PL nIz
-OPT1PL AlIm
-PROG yor Iyor
-AOR r Ar Ir
-PASS.AOR nIr
-PST dI tI
-EVID mIş
-EVID+COND mIşsA
-COND sA
-FUT AcAk yAcAk
-FUT.SOFT AcAğ yAcAğ
-FUT+P3 AcAğI
-FUT+PST AcAktI
-NEG mA
-NEG.AOR mAz
-NECES mAlI
-ABIL+NEG AmA
-PART dIk tIk
-PART.SOFT dIğ
-PART+P3 dIğI tIğI
-ADV.SINCE AlI
-ADV.TIME IncA
-CONV ArAk
-INF mAk
-VN+NEG lAmA
-VN+LOC mAktA
-Q mI
-Q+EPIS mIdIr
-WITH lI
-WITHOUT sIz
-AGT cI çI
-ABSTR lIk
-ADJ.TR sAl
""") | as_listed("""
-ABSTR lığ liğ
-ABIL bil
-NEG.INF maya
-PART.ACT yan ren
-PASS.SFX iril
-PL.SFX ri
-REL ki
-WHEN ken
-YON yon iyon asyon izasyon
""")  # the second part: fixed values, as these occur in single forms only

#: Suffixes that may follow an apostrophe, longest first.
APOSTROPHE_SUFFIXES = sorted(
    {form for pattern in "A yA I yI nI dA tA ndA dAn tAn In nIn dAki ki lAr lArA lArI Im nIz mIz lI lIk sIz".split() for form in harmonise(pattern)}, key=lambda s: (-len(s), s)
)

#: Morpheme of each suffix form: case and number, person, tense and mood, derivation.
MORPHEMES = by_rule("""
ACC I yI
DAT A yA
LOC dA tA
ABL dAn tAn
GEN In nIn
INS lA ylA
PL lAr
1SG Im
1PL Iz
PROG yor Iyor
AOR Ar Ir
PAST dI tI
EVID mIş
COND sA
NEG mA
PASS Il
INF mAk
Q mI
WITH lI
WITHOUT sIz
AGT cI çI
ABSTR lIk
""")
