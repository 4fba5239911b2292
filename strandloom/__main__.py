from strandloom.plans.pipeline import main

main()
