"""changelens: change-impact analytics and corpus operators on Spark DataFrames."""
