"""Texts by script, each a list of its sentences, written after the splitter and not used to adjust it."""

TEXTS = {
    "Latin, English": [
        ["Mrs. Patel arrived at 7.45 p.m. on Friday.", "She had lost 3.2 kg since Dr. Ito's visit.", "“Is it serious?” she asked.", "Nobody knew!"],
        ["The assay (cf. Sect. 2.1) was repeated, e.g. for plates 4 and 5.", "See Figs. 3 and 4 for details.", "No. 7 failed."],
        ["We used IL-6, TNF-α etc. as markers.", "Levels rose approx. 2.5-fold vs. baseline.", "Why?", "We do not know..."],
        ["He wrote: “Stop the drug. It harms me.” and left.", "The U.S. cohort was larger.", "J. K. Mora et al. agreed."],
    ],
    "Latin, German": [
        ["Die Visite war am 3. Mai um 8.30 Uhr.", "Dr. Weiß fand z. B. keine Ödeme.", "„Geht es Ihnen gut?“, fragte sie.", "Ja!"],
        ["Die Dosis wurde ca. 2-mal erhöht, d. h. auf 20 mg.", "Vgl. Abb. 5 auf S. 12.", "Prof. Kurz stimmte zu."],
    ],
    "Latin, French": [
        ["M. Petit est venu à 9 h.", "Il prend p. ex. du fer.", "« Est-ce grave ? » demanda-t-il.", "Non !"],
        ["La fig. 2 montre env. 40 cas.", "Mme Roy a dit : « Tout va bien. »", "Elle est partie."],
    ],
    "Latin, Spanish": [
        ["El Dr. Gil llegó a las 8.", "¿Le duele mucho?", "¡Claro que sí!", "La Sra. Paz tomó 2,5 mg."],
        ["En EE. UU. hubo 30 casos.", "Véase la pág. 4.", "No hay más datos."],
    ],
    "Cyrillic": [
        ["Больной поступил в 2019 г. с жалобами на боль.", "Доза составила 2,5 мг, т. е. половину.", "«Вам лучше?» — спросил врач.", "Да!"],
        ["См. рис. 4 и табл. 2.", "Проф. Орлов согласился.", "Почему?"],
    ],
    "Greek": [["Ο κ. Νίκου ήρθε στις 8.", "Πονάτε πολύ;", "Ναι!", "Η δόση ήταν 2,5 mg."], ["Βλ. εικ. 3.", "Τα αποτελέσματα ήταν καλά."]],
    "Arabic": [["وصل المريض صباحا.", "هل تشعر بألم؟", "نعم!", "كانت الجرعة 2.5 ملغ."], ["قال د. سامي إن النتائج جيدة.", "انتهت الدراسة."]],
    "Devanagari": [["रोगी सुबह आया।", "क्या दर्द है?", "हाँ!", "खुराक 2.5 mg थी।"], ["डॉ. राव ने दवा दी।", "वह ठीक है।"]],
    "Chinese": [["患者早上来了。", "医生问：“还疼吗？”", "他说不疼！", "剂量为2.5 mg。"], ["“明天再来。”护士说。", "他走了。"], ["今天好多了吗？", "（见图3。）", "结果很好……"]],
    "Japanese": [["患者は朝来た。", "「痛みますか？」と医師は聞いた。", "いいえ！", "用量は2.5 mgだった。"], ["「もう大丈夫です。」と言った。", "彼は帰った。"]],
    "Thai": [["เมื่อวานไปหาหมอมาครับ", "หมอให้ยามาสองขวด"], ["กินยาแล้วดีขึ้นไหม", "ยังปวดอยู่ค่ะ", "พรุ่งนี้จะไปตรวจอีกครั้ง"], ["ผู้ป่วยอายุ 45 ปี มีไข้สูง", "แพทย์ให้นอนโรงพยาบาล"]],
    "Lao": [["ມື້ວານໄປຫາໝໍ", "ໝໍໃຫ້ຢາສອງກະປ໋ອງ"], ["ເຈັບທ້ອງບໍ່", "ບໍ່ເຈັບແລ້ວຈ້າ", "ມື້ອື່ນໄປກວດອີກ"]],
    "Khmer": [["គាត់មកពេទ្យពីព្រឹក។", "តើឈឺទេ?", "មិនឈឺទេ។"]],
    "Burmese": [["လူနာ မနက်က ရောက်သည်။", "နာသေးလား။", "မနာတော့ပါ။"]],
    "Armenian, Ethiopic, Tibetan": [["Բժիշկը եկավ։", "Հիվանդը լավ է։"], ["ሐኪሙ መጣ።", "በሽተኛው ደህና ነው።"], ["སྨན་པ་ཕེབས་སོ།", "ནད་པ་དྲག་གོ།"]],
    "Urdu, Hebrew, Korean": [["مریض صبح آیا۔", "کیا درد ہے؟", "جی ہاں۔"], ["החולה הגיע בבוקר.", "כואב לך?", "לא!"], ["환자는 아침에 왔다.", "아픕니까?", "아니요!"]],
}
SPACELESS = {"Chinese", "Japanese"}


def joined(script: str, sentences: list[str]) -> str:
    return ("" if script in SPACELESS else " ").join(sentences)
