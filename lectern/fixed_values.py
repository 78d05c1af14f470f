"""Rule tables, word lists, lookup tables and result texts.

Everything here is a constant that results must carry unchanged. Tables are in natural order; an ordered rule
is (substrings, result) and the first rule with a substring in the lower-cased input wins.
"""

from __future__ import annotations

# ------------------------------------------------------------------ quiz topics, banks and keywords

TOPIC_RULES = [
    (["python"], "python"),
    (["pandas"], "pandas"),
    (["sql", "database"], "sql"),
    (["statistics", "probability"], "statistics"),
    (["deep learning", "neural"], "deep learning"),
    (["nlp", "natural language"], "nlp"),
    (["visualization", "viz"], "data visualization"),
    (["big data", "pyspark", "spark"], "big data"),
]
TOPIC_DEFAULT = "machine learning"

TOPIC_KEYWORDS = {
    "python": ["python", "list", "tuple", "dict", "exception", "copy", "class", "init"],
    "pandas": ["pandas", "dataframe", "csv", "fillna", "merge", "isnull", "read_csv"],
    "sql": ["sql", "database", "join", "having", "group by", "primary key", "acid"],
    "statistics": ["statistics", "probability", "mean", "median", "variance", "iqr", "skewness", "kurtosis"],
    "machine learning": ["machine learning", "regression", "classification", "f1", "r-squared", "sigmoid"],
    "deep learning": ["deep learning", "neural", "relu", "softmax", "sigmoid", "neuron"],
    "nlp": ["nlp", "language", "token", "embedding", "text", "transformer"],
    "data visualization": ["visualization", "plot", "chart", "graph", "matplotlib", "seaborn"],
    "big data": ["big data", "spark", "pyspark", "distributed", "hadoop"],
}

BANK_RULES = [
    (["workflow", "ingestion", "integrating python"], "workflows"),
    (
        ["exploratory", "eda", "outliers", "profiling", "cleansing", "handling outliers", "statistical analysis"],
        "exploration",
    ),
    (
        ["predictive", "modeling", "regression", "classification", "continuous estimation", "categorical classification"],
        "modeling",
    ),
    (["deployment", "deploy", "packaging", "pipelines", "framework", "roadmap", "serving"], "deployment"),
    (["python"], "python"),
    (["pandas"], "pandas"),
    (["sql", "database"], "sql"),
    (["statistics", "probability"], "statistics"),
    (["deep learning", "neural"], "deep learning"),
    (["nlp", "natural language"], "nlp"),
    (["visualization", "plotting"], "visualization"),
    (["pyspark", "big data", "spark"], "big data"),
    (["machine learning", "ml"], "machine learning"),
]
BANK_DEFAULT = "general"

# --------------------------------------------------------------------------------- project ideas

PROJECT_RULES = [
    (["exploratory", "eda"], "exploration"),
    (["supervised"], "supervised"),  # skipped when the topic says "unsupervised"
    (["unsupervised", "clustering"], "unsupervised"),
    (["deep learning", "neural"], "deep learning"),
    (["nlp", "natural language"], "nlp"),
    (["vision", "cv", "image"], "vision"),
    (["time series", "forecasting"], "forecasting"),
    (["fastapi", "microservice", "deploy", "service"], "services"),
]
PROJECT_DEFAULT = "general"
DIFFICULTY_RULES = [(["beginner"], "beginner"), (["advanced"], "advanced")]
DIFFICULTY_DEFAULT = "intermediate"

# ------------------------------------------------------------------------------- code submissions

REVIEW_DROPNA = {
    "status": "Needs Improvement",
    "review_summary": "Good approach — `dropna()` removes missing values correctly. However, your code has a few issues regarding state persistence and memory efficiency.",
    "line_by_line_feedback": "- **State Persistence**: `df.dropna()` returns a copy by default. The original DataFrame 'df' remains unmodified. Consider reassigning it as `df = df.dropna()` or using `inplace=True`.\n- **Memory Optimization**: Use `df.dropna(inplace=True)` to modify the DataFrame directly without creating an unnecessary copy in memory (highly critical for large datasets).\n- **Targeted Cleanup**: Use the `subset` parameter (e.g., `df.dropna(subset=['column_name'])`) if you only want to drop rows where a specific column is null, avoiding accidental deletion of useful rows.",
    "optimized_alternative_code": "```python\n# Recommended: Reassign with subset to keep the DataFrame valid\ndf = df.dropna(subset=['target_column'])\n\n# Alternative: Modify in-place for memory optimization on large datasets\ndf.dropna(inplace=True)\n```",
}
REVIEW_LOOP = {
    "status": "Needs Improvement",
    "review_summary": "Iterating over DataFrame rows using loops is a slow and inefficient anti-pattern in pandas. Vectorized operations should be used instead.",
    "line_by_line_feedback": "- **Vectorization**: Instead of looping row-by-row using `iterrows()` or a standard for loop, perform operations directly on pandas Series. This leverages underlying C-optimized implementations.\n- **Alternative**: Use built-in vectorized functions or `.apply()` / `.map()` for more complex element-wise operations.",
    "optimized_alternative_code": "```python\n# Slow Loop Anti-pattern:\n# for index, row in df.iterrows():\n#     df.loc[index, 'total'] = row['a'] + row['b']\n\n# Fast Vectorized Solution:\ndf['total'] = df['a'] + df['b']\n```",
}
REVIEW_FINE = {
    "status": "Correct",
    "review_summary": "The submitted code logic looks sound and follows standard Python and Pandas data science practices.",
    "line_by_line_feedback": "- No major anti-patterns or inefficiencies detected in the code structure.",
    "optimized_alternative_code": "```python\n# Code is already optimal\n%s\n```",
}
LOOP_MARKS = ["for index", "iterrows()", "itertuples()"]

# ------------------------------------------------------------------------------ coding challenges

# (language, level, title, sample input, sample output, learning objective)
CHALLENGES = [
    ("python", "beginner", "Reverse Words in a String", "'  hello world  '", "'world hello'",
     "Master basic string operations, list manipulation, and whitespace handling in Python."),
    ("python", "intermediate", "Find All Anagrams in a String", "s = 'cbaebabacd', p = 'abc'", "[0, 6]",
     "Implement sliding window algorithms, hash mapping, and count optimization in Python."),
    ("python", "advanced", "Merge k Sorted Lists", "[[1, 4, 5], [1, 3, 4], [2, 6]]", "[1, 1, 2, 3, 4, 4, 5, 6]",
     "Utilize advanced data structures (Heaps / Priority Queues) and divide-and-conquer optimization techniques."),
    ("sql", "beginner", "Find Customers Who Never Order",
     "Customers: {id: 1, name: 'Joe'}, Orders: {id: 1, customerId: 3}", "'Joe'",
     "Understand basic relational filtering using joins, null comparisons, and filtering criteria."),
    ("sql", "intermediate", "Highest Grade For Each Student",
     "Enrollments: {student_id: 1, course_id: 2, grade: 95}, {student_id: 1, course_id: 3, grade: 95}",
     "student_id: 1, course_id: 2, grade: 95",
     "Master SQL window functions (ROW_NUMBER, PARTITION BY) and multi-level sorting constraints."),
    ("sql", "advanced", "Active Users Session Analytics",
     "UserLogins: {user_id: 1, login_date: '2026-06-01'}, {user_id: 1, login_date: '2026-06-02'}, {user_id: 1, login_date: '2026-06-03'}",
     "user_id: 1", "Implement complex SQL consecutive data clustering and advanced temporal analysis."),
    ("data analysis", "beginner", "Calculate Missing Weights", "pd.DataFrame({'weight': [10.0, None, 15.0, 20.0]})",
     "pd.DataFrame({'weight': [10.0, 15.0, 15.0, 20.0]})",
     "Perform basic missing data profiling and median imputation using Pandas."),
    ("data analysis", "intermediate", "Calculate Correlation Metrics",
     "df = pd.DataFrame({'A': [1,2,3], 'B': [2,4,5.9], 'C': [10, 1, 5]}), threshold = 0.95", "[('A', 'B')]",
     "Perform Exploratory Data Analysis (EDA) correlation computations and filter collinear variables."),
    ("data analysis", "advanced", "Calculate Cohort Retention Rates", "df with transaction rows",
     "Pivot DataFrame with percentage retention",
     "Build advanced customer lifecycle segmentation metrics using pivot tables and complex Pandas grouping."),
]
CHALLENGE_LANGUAGES = ["python", "sql", "data analysis"]
CHALLENGE_LEVELS = ["beginner", "intermediate", "advanced"]

GRADE_DEFAULT = ("Success", 95, "Fantastic solution! Your code matches the challenge guidelines and compiles cleanly.")
GRADE_SLICING = (
    "Needs Optimization", 70,
    "Your solution works but could be made simpler by leveraging built-in python list slicing ([::-1]) and ' '.join().",
)

# Model solutions that come back with a grade: (language, words of the title, solution).
SOLUTION_REVERSE = "```python\ndef reverse_words(s: str) -> str:\n    # Split automatically segments by any whitespace run and cleans leading/trailing spaces\n    words = s.split()\n    # Reverse and join back with single space\n    return ' '.join(words[::-1])\n```"
SOLUTION_SLICING = "```python\ndef reverse_words(s: str) -> str:\n    return ' '.join(s.split()[::-1])\n```"
SOLUTIONS = [
    ("python", "anagrams", "```python\ndef find_anagrams(s: str, p: str) -> list:\n    # Optimized sliding window using character counts\n    from collections import Counter\n    p_count = Counter(p)\n    s_count = Counter()\n    res = []\n    ns, np = len(s), len(p)\n    for i in range(ns):\n        s_count[s[i]] += 1\n        if i >= np:\n            if s_count[s[i-np]] == 1:\n                del s_count[s[i-np]]\n            else:\n                s_count[s[i-np]] -= 1\n        if s_count == p_count:\n            res.append(i - np + 1)\n    return res\n```"),
    ("sql", "never order", "```sql\n-- Optimal solution using LEFT JOIN\nSELECT c.name AS Customers\nFROM Customers c\nLEFT JOIN Orders o ON c.id = o.customerId\nWHERE o.id IS NULL;\n```"),
    ("sql", "highest grade", "```sql\n-- Optimal solution using ROW_NUMBER window function\nWITH RankedEnrollments AS (\n    SELECT student_id, course_id, grade,\n           ROW_NUMBER() OVER (PARTITION BY student_id ORDER BY grade DESC, course_id ASC) as rn\n    FROM Enrollments\n)\nSELECT student_id, course_id, grade\nFROM RankedEnrollments\nWHERE rn = 1\nORDER BY student_id;\n```"),
]

STATUS_BADGES = {"Success": "✅ Solved", "Failed": "❌ Incorrect", None: "⚠️ Needs Optimization"}
REVIEW_BADGES = {"Correct": "✅", "Incorrect": "❌", None: "⚠️"}

# -------------------------------------------------------------------------------------- interviews

INTERVIEW_DEFAULT = "python programming"
INTERVIEW_QUESTIONS = {
    "python programming": [
        "Write a function `is_palindrome(s: str) -> bool` that checks if a string is a palindrome. Consider edge cases like whitespace and casing. Time limit: 5 minutes.",
        "How does a generator differ from a normal list in Python? Provide an example generator function. Time limit: 5 minutes.",
        "Explain the GIL (Global Interpreter Lock) in Python and how it affects multi-threaded programs. Time limit: 5 minutes.",
    ],
    "sql databases": [
        "Write a SQL query to find the second highest salary from an `Employee` table. If there is no second highest salary, return NULL. Time limit: 5 minutes.",
        "Explain the difference between WHERE and HAVING clauses. Give an example query utilizing both. Time limit: 5 minutes.",
        "What are database indexes, and how do B-Trees optimize SELECT queries? Are there any disadvantages to indexes? Time limit: 5 minutes.",
    ],
    "machine learning": [
        "Explain the bias-variance tradeoff. How do you identify if a model has high bias or high variance? Time limit: 5 minutes.",
        "Explain how you would compute precision and recall from a confusion matrix. Explain the difference between them. Time limit: 5 minutes.",
        "How does Random Forest handle feature importance? How is it calculated? Time limit: 5 minutes.",
    ],
    "statistics & probability": [
        "Explain p-value. How does it relate to the null hypothesis? If a p-value is 0.03 under alpha=0.05, what is your decision? Time limit: 5 minutes.",
        "What is Bayes' Theorem? Provide the formula and describe a real-world scenario where it is applied. Time limit: 5 minutes.",
        "What is the Central Limit Theorem? Why is it fundamental to statistical inference? Time limit: 5 minutes.",
    ],
}
EVALUATION_FIELDS = ["feedback", "correctness", "clarity", "approach", "code_quality"]
EVALUATION_DEFAULT = (
    7,
    "Good attempt. Your answer covers some base requirements, but could be made more precise.",
    "Mostly correct, but misses some key edge cases or optimizations.",
    "The explanation is reasonably clear but could structure the logic better.",
    "Logical approach, though there are more optimal ways to handle the complexity.",
    "Basic code format is okay; try using cleaner variable naming or descriptive comments.",
)
# (topic contains, question contains, answer contains any, score, feedback, correctness, clarity, approach, code quality)
EVALUATION_RULES = [
    ("python programming", "is_palindrome", ["replace(", "lower()", "[::-1]"], 9,
     "Excellent! You correctly used string slicing `[::-1]` for reversing and handled casing/whitespace via `.lower()` or `.replace()`.",
     "Fully correct and handles case/whitespace differences.",
     "Clear and easy to understand logic.",
     "Optimal O(N) time and O(N) space. For O(1) space, a two-pointer approach could be used.",
     "High quality code."),
    ("python programming", "generator", ["yield"], 9,
     "Great explanation. Generators use the `yield` keyword and evaluate lazily (saving memory), whereas lists are fully computed in memory.",
     "Correct distinction between lazy generation and eager evaluation.",
     "Excellent clear conceptual differentiation.",
     "Correct code example showing a standard generator.",
     "Good Python syntax."),
    ("sql databases", "second highest", ["limit", "offset", "subquery", "max("], 9,
     "Very good. Using `LIMIT 1 OFFSET 1` with a subquery (or sorting with distinct) is a standard approach to find the second highest salary.",
     "Correct query syntax.",
     "Logic is well explained.",
     "Optimal SQL query approach.",
     "Clean SQL capitalization."),
    ("machine learning", "bias-variance", ["overfit", "underfit"], 9,
     "Excellent definition. High bias causes underfitting (simplistic model), whereas high variance causes overfitting (model fits noise).",
     "Accurate conceptual understanding of the tradeoff.",
     "Clear and well-structured explanation.",
     "Good identification guidelines (evaluating train vs validation error).",
     "Concept explanation (no code required)."),
    ("statistics & probability", "p-value", ["reject", "null"], 9,
     "Correct! Since the p-value (0.03) is less than the significance level alpha (0.05), you reject the null hypothesis.",
     "Correct decision rule and decision.",
     "Clear, direct explanation.",
     "Excellent scientific approach.",
     "Concept explanation."),
]
# Palindrome answers without a function: score, feedback, correctness; the other fields keep the default.
EVALUATION_NO_FUNCTION = (
    4, "You should define the function `is_palindrome` as requested by the prompt.", "Function definition is missing.",
)
ASSESSMENT_STRENGTHS = "- Solid conceptual grasp of the basic subject terminology.\n- Capable of writing syntactically correct snippets for basic problems.\n- Good effort in addressing coding problems directly without leaving blank."
ASSESSMENT_WEAKNESSES = "- May miss edge cases (e.g. casing/special characters in string processing, NULL values in database records).\n- Could detail explanations more thoroughly to show deeper architectural knowledge.\n- Variable naming and inline comments could be improved for production readiness."
ASSESSMENT_SUGGESTIONS = "- **Practice Edge Cases**: When solving coding problems, explicitly declare and test constraints and null values.\n- **Study Vectorization and Optimization**: Focus on performance and memory usage (e.g., using generators or vectorized queries).\n- **Simulate Timed Environments**: Solve Leetcode/HackerRank questions under strict time limits to build confidence."
SCORE_BANDS = [(8, "🟢 Strong"), (5, "🟡 Average"), (None, "🔴 Needs Improvement")]

# ------------------------------------------------------------------------------- spoken questions

SPOKEN_RULES = [(["python"], "python"), (["sql"], "sql")]
SPOKEN_REPLIES = {
    "python": (
        "Python is a high-level, general-purpose programming language. For data science, it is the industry standard because of its readability and robust libraries like Pandas and NumPy.\n\n**Code Example:**\n```python\n# Defining a simple list comprehension in Python\nsquares = [x**2 for x in range(5)]\nprint(squares) # Output: [0, 1, 4, 9, 16]\n```",
        "Python is a simple, readable programming language that is the standard in data science. An example is using list comprehensions to write concise loops, like creating a list of squared numbers.",
    ),
    "sql": (
        "SQL (Structured Query Language) is used to communicate with databases. It allows you to query, filter, and aggregate records.\n\n**Code Example:**\n```sql\nSELECT department, AVG(salary) \nFROM employees \nGROUP BY department;\n```",
        "SQL is the standard language for querying and managing relational databases. You can use it to select data, filter rows, or group records, such as calculating the average salary per department.",
    ),
    "other": (
        "I heard you ask about: '%s'. Data science involves analyzing data, building predictive models, and communicating insights. Let me know if you want to write some Python, query SQL, or discuss statistical assumptions!",
        "I received your question about %s. Data science combines programming, statistics, and business insight to solve complex problems. Let me know what specific topic you would like to explore next.",
    ),
}

# ---------------------------------------------------------------------------------- learning paths

TRACK_RULES = [
    (["data analysis", "data analytics", "data analyst"], "data_analysis_learning_path"),
    (["python", "sql"], "python_sql_learning_path"),
    (["java"], "java_learning_path"),
]
# (track, week, topic, details)
TRACK_WEEKS = [
    ("java_learning_path", 1, "Java Fundamentals & Core Programming Concepts",
     "Build a strong foundation in Java syntax, variables, data types, operators, control flow, methods, and basic program structure. Practice writing small console programs to reinforce input, output, and logical thinking."),
    ("java_learning_path", 2, "Object-Oriented Programming (OOP) & Class Design",
     "Learn classes, objects, constructors, inheritance, encapsulation, polymorphism, abstraction, and interfaces. Focus on designing reusable code with clean class structures and proper access modifiers."),
    ("java_learning_path", 3, "Collections Framework & Exception Handling",
     "Study ArrayList, LinkedList, HashMap, HashSet, iterators, and generics. Pair that with try-catch blocks, custom exceptions, and safe error handling patterns for real programs."),
    ("java_learning_path", 4, "Advanced Java Development & Project Implementation",
     "Explore file handling, streams, lambda expressions, and project structure. Finish with a small Java project that combines OOP, collections, and exception handling into one practical application."),
    ("python_sql_learning_path", 1, "Statistics",
     "Build the statistical foundation needed for data work and model interpretation."),
    ("python_sql_learning_path", 2, "Pandas", "Work with tabular data using pandas for transformation and analysis."),
    ("python_sql_learning_path", 3, "Visualization", "Communicate insights clearly with charts and exploratory visuals."),
    ("python_sql_learning_path", 4, "ML Basics",
     "Learn the first machine learning workflow from data split to model evaluation."),
    ("data_analysis_learning_path", 1, "Data Analysis Fundamentals & Data Profiling Techniques",
     "Build the foundation for analytical thinking, data types, and profiling before deeper analysis."),
    ("data_analysis_learning_path", 2, "Data Cleaning, Transformation & Exploratory Data Analysis",
     "Prepare datasets, transform fields, and explore distributions, relationships, and anomalies."),
    ("data_analysis_learning_path", 3, "Data Manipulation, SQL & Dashboard Development",
     "Practice SQL querying, joins, aggregations, and communicate findings through dashboards."),
    ("data_analysis_learning_path", 4, "Statistical Analysis, Business Insights & Project Deployment",
     "Turn analysis into business recommendations and package the final project for sharing."),
]

TITLE_STOPWORDS = [
    "the", "and", "for", "with", "from", "that", "this", "into", "your", "course", "lesson",
    "module", "section", "topic", "topics", "overview", "introduction", "advanced", "learn", "using",
    "based", "data", "science", "learning", "guide", "notes", "content", "week", "weeks", "chapter",
    "part", "level", "beginner", "intermediate",
]

# (week, name, details, tags)
DEFAULT_SUBTOPICS = [
    (1, "Baseline Knowledge Synthesis",
     "Master Python's core built-in data structures (Lists, Dictionaries, Sets), list comprehensions, and lambda functions for inline utility.",
     ["python", "lists", "dictionaries", "sets", "list comprehensions", "lambda", "loops"]),
    (1, "The Core Data Science Stack",
     "Foundational ecosystem libraries: NumPy for vectorized calculations, Pandas for DataFrames, and Matplotlib/Seaborn for visualization.",
     ["numpy", "pandas", "matplotlib", "seaborn", "python", "visualization", "data science stack", "libraries"]),
    (1, "Data Ingestion Workflows",
     "Ingesting from flat files (CSV), semi-structured APIs (JSON), and enterprise relational databases (SQL) using python connections.",
     ["csv", "json", "api", "sql", "ingestion", "database", "sqlite", "relational", "databases", "flat files"]),
    (2, "Statistical Analysis Foundations",
     "Central tendency (mean, median, mode) and dispersion (variance, standard deviation, skewness, tail dominance, Kurtosis peaking).",
     ["statistics", "mean", "median", "mode", "variance", "std", "distribution", "kurtosis", "hypothesis", "stats"]),
    (2, "Dataset Profiling Techniques",
     "Systematic handling of missing values with dropna/fillna and structural casting to optimize schema performance.",
     ["profiling", "missing", "dropna", "fillna", "type casting", "pandas", "cleansing"]),
    (2, "Spotting and Handling Outliers",
     "Isolating anomalies using Interquartile Range (IQR) and Z-score variance thresholds.",
     ["outliers", "iqr", "z-score", "anomaly", "eda"]),
    (3, "Linear Regression (Continuous Estimation)",
     "Ordinary Least Squares parameter estimation, R2 score explanation, and performance error metrics (MSE, MAE).",
     ["linear regression", "regression", "ols", "r2", "mse", "mae", "modeling", "machine learning"]),
    (3, "Logistic Regression (Categorical Classification)",
     "Solving binary classification flag determinations using Sigmoid activation and log-loss cost minimization.",
     ["logistic regression", "regression", "sigmoid", "classification", "binary", "modeling", "machine learning"]),
    (3, "Performance Evaluation Metrics",
     "Quantifying model success using Precision, Recall, F1-Score harmonic mean, Confusion Matrix, and ROC-AUC curves.",
     ["metrics", "precision", "recall", "f1", "confusion matrix", "roc", "auc", "evaluation"]),
    (4, "Packaging Data Pipelines",
     "Refactoring notebook code into modular classes and structured packages, utilizing virtual environments.",
     ["pipeline", "packaging", "modular", "python", "codebase", "package"]),
    (4, "Light Deployment Frameworks",
     "Building presentation APIs and user interfaces using Streamlit, Flask, or FastAPI.",
     ["deployment", "streamlit", "flask", "fastapi", "api", "serving", "web"]),
    (4, "Future Professional Roadmap",
     "Establishing version control with Git/GitHub, cloud deployment, and continuous model optimization.",
     ["roadmap", "git", "github", "cloud", "advanced", "version control"]),
]

# Filler for a week without topics, by week position.
FILLER_WEEKS = [
    ("MLOps", "Pipeline orchestration, CI/CD, and model registry."),
    ("Big Data Scaling", "Distributed systems, Spark, and cloud data warehouses."),
    ("Advanced Optimization", "Deep learning architectures, hyperparameter tuning, and advanced estimators."),
]
# The plan when no topic is left.
FINISHED_PLAN = [
    ("Advanced Topics & Research", "Since you already have a solid foundation in the core topics, focus on state-of-the-art models and production scaling."),
    ("Cloud Data Engineering", "Learn about distributed storage, streaming architectures (Kafka), and cloud databases (BigQuery/Snowflake)."),
    ("Large Language Models & GenAI", "Dive into transformers, fine-tuning LLMs, vector search embeddings, and agentic workflows."),
    ("MLOps & System Design", "Model monitoring, CI/CD for machine learning, pipeline orchestration, and low-latency serving."),
]

# ------------------------------------------------------------------------------------ seed documents

SEED_DOCUMENTS = [
    ("data_science_fundamentals.txt",
     "Handling missing records and missing values is a crucial step in data preprocessing. In Pandas, we can identify missing records using df.isnull() or df.isna(). To handle missing records, we can drop them using df.dropna(), which removes any rows with null values. Alternatively, we can impute missing values using df.fillna(). For instance, filling null values with the median using df['column'].fillna(df['column'].median()) or the mean using df['column'].fillna(df['column'].mean()). Using inplace=True or reassigning the DataFrame is necessary to persist these changes. Advanced imputation includes forward fill (ffill) or backward fill (bfill) for time-series data."),
    ("overfitting_guide.txt",
     "Overfitting is when a model fits the training data too closely. We can prevent overfitting by using regularization techniques. This is a very important concept in machine learning and data science. Bias and variance trade-off is essential to get the best performance."),
]

# ---------------------------------------------------------------------------------- model narrative

HEALTH_BANDS = [
    (0.15, "🔴", "Overfitting Risk"),
    (0.08, "🟡", "Mild Generalization Gap"),
    (None, "🟢", "Healthy"),
]
HEALTH_TEXTS = {
    "Overfitting Risk": "⚠️ **Overfitting Detected**: There is a notable gap between train {m} ({tr}) and test {m} ({te}). The model has memorized training patterns rather than learning general rules. Consider adding regularization, reducing model complexity, or increasing dataset size.",
    "Mild Generalization Gap": "🟡 **Mild Generalization Gap**: Train {m} ({tr}) is somewhat higher than test {m} ({te}). The model generalizes reasonably but may benefit from cross-validation tuning.",
    "Healthy": "✅ **Healthy Generalization**: Train {m} ({tr}) is close to test {m} ({te}). The model generalizes well to unseen data.",
}
