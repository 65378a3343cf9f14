"""Wordings of residue and of plain reports on it, written from general knowledge of web pages and none of them taken from a given table.

TUNED may be looked at when the word lists are changed; HELD is only measured.
"""

TUNED = """
The page you requested could not be found.
Oops! That page can't be found.
We're sorry, but this page is no longer available.
This site can't be reached.
An unexpected error occurred. Please try again later.
Internal Server Error: the server encountered an error and could not complete your request.
502 Bad Gateway nginx
Your connection was interrupted. Check your network settings and reload the page.
You must be logged in to view this content.
Access to this page has been denied.
Please verify you are a human.
Please turn JavaScript on and reload the page.
We use cookies to improve your experience. Please enable cookies to continue.
The site is down for maintenance. Please check back soon.
Your session timed out. Please sign in again.
Die angeforderte Seite existiert nicht.
Bitte melden Sie sich an, um den Inhalt anzuzeigen.
Cette page n'existe pas ou a été supprimée.
Votre session a expiré, veuillez vous reconnecter.
La página que busca no existe.
Su sesión ha expirado. Inicie sesión de nuevo.
A página que procura não existe.
Запрашиваемая страница не существует.
Ваша сессия истекла, войдите снова.
您访问的页面不存在。
服务器错误，请稍后重试。
サーバーエラーが発生しました。
ไม่พบหน้าที่คุณต้องการ
पृष्ठ उपलब्ध नहीं है।
This is dummy text. Replace it before publication.
Abstract text to be inserted here.
""".strip().split("\n")

HELD = """
Sorry, we couldn't find the page you were looking for.
The requested URL was not found on this server.
HTTP Error 503. The service is unavailable.
504 Gateway Timeout
Something went wrong. Please refresh the page.
An error has occurred while processing your request.
Error establishing a database connection.
Fatal error: uncaught exception in script.
You are not authorized to access this page.
Your IP address has been blocked.
Please complete the captcha to continue.
This website is using a security service to protect itself from online attacks.
Please enable cookies and reload the page.
This application requires JavaScript to run.
You need to allow JavaScript in your browser to use this site.
We are currently performing scheduled maintenance and will be back shortly.
The server is temporarily unable to service your request.
Your login has expired. Please log in again.
This link is invalid or has expired.
The document you requested has been removed.
Diese Seite wurde nicht gefunden.
Ihre Sitzung ist abgelaufen. Bitte melden Sie sich erneut an.
Der Server ist derzeit nicht erreichbar.
Bitte schalten Sie JavaScript in Ihrem Browser ein.
Une erreur est survenue. Veuillez réessayer plus tard.
Vous n'avez pas accès à cette page.
Le service est momentanément indisponible.
Ha ocurrido un error en el servidor.
No tiene permiso para acceder a este contenido.
Por favor, active JavaScript en su navegador.
Ocorreu um erro. Por favor, tente novamente.
O seu acesso foi negado.
Произошла ошибка. Попробуйте позже.
Доступ к сайту запрещён.
Пожалуйста, включите поддержку JavaScript.
访问被拒绝。
请登录后继续浏览。
お探しのページは削除された可能性があります。
アクセスが拒否されました。
เกิดข้อผิดพลาด กรุณาลองใหม่อีกครั้ง
คุณไม่มีสิทธิ์เข้าถึงหน้านี้
त्रुटि हुई, कृपया पुनः प्रयास करें।
कृपया अपने ब्राउज़र में जावास्क्रिप्ट सक्षम करें।
Placeholder text for the summary section.
Sample abstract, to be replaced.
Summary to be provided by the authors.
Ihr Text steht hier.
Texte provisoire à remplacer.
""".strip().split("\n")

# Sentences of real texts that speak of pages, scripts, errors or fill-in text: no residue.
REPORTS = """
Patients whose login had expired were asked to register again, and 12% never finished the questionnaire.
Of 340 web addresses in the guidelines, 41 led to a missing page and 12 to a server error.
The survey was offline for two days because of maintenance at the university, which delayed enrolment.
Nurses used a browser extension written in JavaScript to record blood pressure.
Access to insulin was denied to one in five rural households.
Error bars show the standard error of the mean in all panels.
Requests for the data may be sent to the corresponding author and will be answered within a month.
Participants were told to try again if the glucose meter showed an error.
The placeholder arm received a dummy inhaler with the same taste.
Sample sizes were calculated for a power of 80%.
The script for the interview was tested in six sessions with older adults.
Service use fell when clinics closed and patients were moved to other sites.
Two reviewers checked the records and resolved disagreements by discussion.
Missing values were replaced by the median of the site.
Trial registration was required before the first visit.
The drug is no longer available in three of the countries studied.
Cookies and sweetened drinks were excluded from the test meal.
Zugriff auf die Akten wurde in vier Kliniken verweigert, sodass 30 Fälle fehlen.
Die Sitzung dauerte im Mittel 40 Minuten und wurde von Pflegekräften geleitet.
L'accès aux soins reste refusé à un patient sur dix dans les zones rurales.
El acceso al tratamiento fue denegado a 14 pacientes con diabetes.
O erro médio da bomba foi menor em crianças do que em adultos.
Доступ к лечению был ограничен в сельских районах, где не хватало врачей.
研究页面的访问记录显示，患者每周登录两次并记录血糖。
患者は毎週ページを開き、血糖値を記録した。
ผู้ป่วยเข้าสู่ระบบสัปดาห์ละสองครั้งเพื่อบันทึกน้ำตาลในเลือด
मरीजों ने हर सप्ताह वेबसाइट पर रक्तचाप दर्ज किया।
""".strip().split("\n")
