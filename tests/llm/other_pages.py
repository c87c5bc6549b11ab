"""Records written apart from the test tables: what widely used web servers, frameworks and editors show, and texts about them.

(host, kind or None for content, text). Used as a held-out set for the detector: nothing in the detector was fitted to it.
"""

CONTENT = (
    "The committee met on Tuesday to discuss the budget for the new harbour bridge. Three contractors had sent offers, and the engineer went through each of them in turn. A decision is expected before the summer break.",
    "Knead the dough for ten minutes, let it rise in a warm place until it has doubled, then shape two loaves. Bake at 230 degrees for half an hour.",
    "Der Zug nach Basel fährt heute von Gleis 7. Wegen einer Baustelle hält er nicht in Offenburg, Reisende steigen bitte in Freiburg um.",
    "Le musée rouvre le 3 mai avec une exposition sur les cartes anciennes. L'entrée est gratuite le premier dimanche du mois.",
    "El equipo ganó el partido en la prórroga gracias a un gol de cabeza. El entrenador alabó la paciencia de sus jugadores.",
)

POSITIVE = [
    # Servers and proxies.
    ("error", "404 Not Found\nnginx/1.18.0 (Ubuntu)"),
    ("error", "Not Found\n\nThe requested URL was not found on this server.\n\nApache/2.4.41 (Ubuntu) Server at example.org Port 443"),
    ("error", "502 Bad Gateway\nnginx"),
    ("error", "HTTP Status 500 – Internal Server Error\nType Exception Report\nThe server encountered an unexpected condition that prevented it from fulfilling the request."),
    ("error", "Service Unavailable\n\nHTTP Error 503. The service is unavailable."),
    ("error", "403 - Forbidden: Access is denied.\nYou do not have permission to view this directory or page using the credentials that you supplied."),
    ("error", "Error 522 Ray ID: 5d2f0a1b8c3e\nConnection timed out\nPlease try again in a few minutes."),
    ("error", "There has been a critical error on this website. Please contact the site administrator."),
    ("error", "Error establishing a database connection"),
    ("error", "This site can't be reached\nexample.org took too long to respond."),
    ("error", "Oops! That page can't be found.\nIt looks like nothing was found at this location. Try a search?"),
    ("error", "429 Too Many Requests"),
    ("error", "Fatal error: Uncaught Error: Call to undefined function get_header() in /var/www/html/index.php:12"),
    ("error", "Your session has expired. Please log in again to continue."),
    ("error", "Access Denied\nYou don't have permission to access \"/reports\" on this server.\nReference ID: 18.2e4d"),
    ("error", "We'll be back soon! Sorry for the inconvenience, the site is undergoing maintenance at the moment."),
    ("error", "Seite nicht gefunden\nDie angeforderte Seite existiert nicht. Zur Startseite"),
    ("error", "Fehler 500: Es ist ein interner Fehler aufgetreten. Bitte versuchen Sie es später erneut."),
    ("error", "Page introuvable\nLa page demandée n'existe pas ou a été déplacée. Retour à l'accueil"),
    ("error", "Página no encontrada\nLa página que busca no existe. Volver al inicio"),
    # Notices.
    ("script", "You need to enable JavaScript to run this app."),
    ("script", "JavaScript is not available.\nWe've detected that JavaScript is disabled in this browser. Please enable JavaScript or switch to a supported browser to continue."),
    ("script", "Please turn on JavaScript in your browser and reload the page."),
    ("script", "This site requires JavaScript to be enabled. Learn how to enable it in your browser settings."),
    ("script", "Checking your browser before accessing example.org. This process is automatic. Please enable JavaScript and cookies to continue."),
    ("script", "Bitte aktivieren Sie JavaScript in Ihrem Browser, um diese Seite zu nutzen."),
    ("script", "Cette page nécessite JavaScript. Veuillez activer JavaScript dans votre navigateur."),
    ("script", "Esta aplicación necesita JavaScript para funcionar. Por favor, active JavaScript."),
    # Filler.
    ("filler", "Lorem ipsum dolor sit amet, consectetur adipiscing elit. Vivamus lacinia odio vitae vestibulum vestibulum. Cras venenatis euismod malesuada."),
    ("filler", "Sed ut perspiciatis unde omnis iste natus error sit voluptatem accusantium doloremque laudantium, totam rem aperiam."),
    ("filler", "Pellentesque habitant morbi tristique senectus et netus et malesuada fames ac turpis egestas. Vestibulum tortor quam, feugiat vitae, ultricies eget, tempor sit amet."),
    ("filler", "asdf asdf asdf qwerty qwerty jkl"),
    ("filler", "Title goes here\nYour text here"),
    ("filler", "Add a short description of your company. Insert your text here."),
    ("filler", "Sample text. Sample text. Sample text."),
    ("filler", "test test test test"),
    ("filler", "Hier steht Ihr Text. Bitte ersetzen."),
    ("filler", "Votre texte ici. Ajoutez un titre."),
    # Placeholders in content.
    ("placeholder", "Dear {{customer_name}}, thank you for your order. It will be sent to you within three days from our warehouse in Rotterdam."),
    ("placeholder", "Hello %FIRST_NAME%, your appointment with the dentist is on Monday at nine; please bring your insurance card."),
    ("placeholder", "The contract between [Company Name] and the supplier ends on the last day of June and is renewed for a year."),
    ("placeholder", "Copyright ${year} the authors. The river rises in the hills and flows through four towns before it meets the sea."),
    ("placeholder", "Der Kurs findet am <DATUM> im großen Saal statt, Getränke werden gereicht."),
    ("placeholder", "The price is TBD and will be given to members first."),
]

NEGATIVE = [
    *CONTENT,
    "A 404 is what a server answers when it does not know the address asked for. The class of codes that begin with 4 blames the client, the class that begins with 5 the server, and proxies may rewrite both.",
    "Last night the mail server was down for two hours because a disk had filled up with logs. We moved the old files to tape and the queue drained by morning.",
    "Our shop lost three sales in March when the payment page timed out for customers in Portugal.",
    "Typesetters have used lorem ipsum since the sixteenth century, when a printer scrambled a passage of Cicero to make a specimen book.",
    "In Mustache templates a tag such as `{{name}}` is replaced by the value of the key, while `{{{name}}}` leaves its markup alone.",
    "JavaScript was written in ten days in 1995; without it the modern web would look quite different, and browsers would be simpler programs.",
    "The author argues that readers who switch scripts off see a faster and calmer web, and tests forty newspapers to prove it.",
    "The printf family takes a format such as \"%d items\" and fills in the numbers in order.",
    "Wenn der Server mit Fehler 503 antwortet, wartet unser Programm zehn Sekunden und fragt dann den zweiten Spiegel in Hamburg.",
    "Le mot « lorem » vient de la fin du mot dolorem, coupé en tête de page par l'imprimeur.",
    "El técnico explicó que el error 500 venía de una tabla corrupta y que la copia del lunes la había reparado.",
    "Shell scripts should quote their variables: echo \"${HOME}\" prints the folder of the user, and unquoted names break at blanks.",
    "The guard refused access to the vault because the inspector's pass had expired in May.",
    "We define the loss as L = \\sum_{i} w_{i} (y_{i} - f(x_{i}))^2 and minimise it over w.",
    "Gallia est omnis divisa in partes tres, wrote Caesar, and generations of pupils have learned the line by heart.",
    "Chapter 4: Server errors\nThe dispatcher keeps a table of the last hundred failures per host. Each entry names the tenant, the shard and the commit that was live at the time.",
    "The recipe site greets visitors without JavaScript with a plain list of dishes, which blind readers praised in the survey.",
    "Array elements are written a[0], a[1] and so on; a matrix element needs two of them, as in m[2][3].",
    "Sales fell by 5 % in spring, rose by 12 % in summer and ended the year % for % where the board had wanted them.",
    "The word placeholder appears twice in the style guide, once for images and once for names that are not yet final.",
    "Refunds: if the connection failed while you paid, the bank returns the money within five days. Keep the receipt that our clerk in Leeds gave you.",
]
