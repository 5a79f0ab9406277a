"""Word lists and patterns that routing depends on.

Fixed values: they are part of the behaviour and stand in their natural order. Words are compared after
normalization, so each is listed once.
"""

SIMPLE_RULES = [
    r"^veri setindeki toplam profil say[ıi]s[ıi] ka[cç]t[ıi]r\??$",
    r"^veri setinde ka[cç] farkl[ıi] sekt[oö]r bulunmaktad[ıi]r\??$",
    r"^veri setinde ka[cç] farkl[ıi] meslek.*bulunmaktad[ıi]r\??$",
]
META = [
    r"do[gğ]rudan belirtilmi[sş]\s*(mi|midir)",
    r"a[cç][ıi]k[cç]a belirtilmi[sş]\s*(mi|midir)",
    r"[cç][ıi]kar[ıi]labilir\s*m[ıi]",
    r"[cç][ıi]kar[ıi]m yap[ıi]labilir\s*m[ıi]",
    r"belirlenebilir\s*m[ıi]",
    r"tespit edilebilir\s*m[ıi]",
    r"ili[sş]kilendirilebilir\s*m[ıi]",
    r"anla[sş][ıi]labilir\s*m[ıi]",
    r"t[uü]retilebilir\s*m[ıi]",
    r"elde edilebilir\s*m[ıi]",
]
CONCEPT = [
    r"ne i[sş]e yarar",
    r"ne i[cç]in kullan[ıi]l[ıi]r",
    r"neden g[oö]r[uü]n[uü]r de[gğ]ildir",
    r"neden .* de[gğ]ildir",
    r"b[oö]l[uü]m[uü]ne g[oö]re .* iddia",
    r"do[gğ]rulamas[ıi] iddia",
    r"hangi .* (alabilir|belirtir|tanımlar|açıklar)",
    r"hangi alanlarla a[cç][ıi]k[cç]a",
    r"sentetik.*oldu[gğ]u",
    r"synthetic",
    r"fieldguide",
    r"safetyanddataquality",
]
COMPLEX = [
    "göre dağılım", "dağılım", "%", "yüzde", "ortalama", "oran", "oranı", "toplam", "en büyük", "en küçük",
    "karşılaştır", "en sık", "en çok", "en az", "en yüksek", "en düşük", "sıralama", "üzerinde", "altında",
    "kaç profil", "kaç farklı", "sayısı kaçtır", "değerleri nedir", "min", "max", "minimum", "maksimum", "filtre",
    "olanlar", "bulunanlar", "içeren", "bakiye", "değişimi", "maliyet", "medyan", "std", "sapma", "histogram",
    "grafik", "grafiğ", "görselleştir", "pasta", "çubuk", "çubuğ",
]
INTERROGATIVE = ["kaç", "hangisi", "hangileri", "oran", "yüzde", "en"]
CONTEXT = [
    r"veri\s*seti", r"veri\s*kumesi", r"dataset", r"tablo", r"kolon", r"sutun", r"satir", r"kayit", r"profil",
    r"istatistik", r"alan[ıi]nda", r"alani", r"\.json", r"\.csv", r"dosyas[ıi]nda",
]
GENERIC = [r"veri seti", r"veri kumesi", r"tablo", r"dataset", r"kayit", r"satir", r"sutun", r"kolon", r"alani\b"]
WEAK_WORDS = {
    "dil", "durum", "tip", "tur", "cesit", "fark", "hesap", "saat", "zaman", "gun", "ay", "yil", "tarih", "ad",
    "isim", "il", "sehir", "ulke", "adet", "sayi", "puan", "skor", "detay", "adres", "mail", "telefon", "sure",
    "dakika", "deneyim", "toplam", "miktar", "sinif", "statu",
}
NO_COLUMN = {"id", "no", "at", "on", "in", "is", "of", "to", "by", "ve", "bir", "the"}
ALIASES = {
    "amount": ["tutar", "miktar", "meblağ"],
    "balance": ["bakiye"],
    "category": ["kategori", "sınıf"],
    "status": ["durum", "statü"],
    "type": ["tür", "tip", "çeşit"],
    "date": ["tarih", "gün", "ay", "yıl"],
    "time": ["saat", "zaman"],
    "description": ["açıklama", "detay"],
    "account_id": ["hesap", "hesap no", "hesap numarası"],
    "account": ["hesap"],
    "customer": ["müşteri"],
    "merchant": ["satıcı", "işyeri"],
    "currency": ["para birimi", "döviz"],
    "transaction": ["işlem", "hareket"],
    "transactions": ["işlem", "hareket"],
    "price": ["fiyat", "ücret"],
    "quantity": ["adet", "miktar"],
    "name": ["ad", "isim"],
    "city": ["şehir", "il"],
    "country": ["ülke"],
    "occupation": ["meslek"],
    "sector": ["sektör"],
    "industry": ["sektör", "endüstri"],
    "experience": ["deneyim", "tecrübe"],
    "language": ["dil"],
    "duration": ["süre", "dakika", "saat"],
    "profile": ["profil"],
    "airport": ["havaalanı", "havalimanı"],
    "latitude": ["enlem"],
    "longitude": ["boylam"],
    "lat": ["enlem"],
    "lon": ["boylam"],
    "email": ["e-posta", "eposta", "mail"],
    "phone": ["telefon"],
    "address": ["adres"],
    "score": ["puan", "skor"],
    "rating": ["puan", "değerlendirme"],
    "count": ["sayı", "adet"],
    "total": ["toplam"],
}
SECTOR_COMPLEX = ["oran", "yuzde", "karsilastir", "fark", "daha", "uzeri", "ustu", "altinda", "dakika", "ortalama"]
